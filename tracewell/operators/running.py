"""Running sums and ranks that do not depend on how large one key is.

A window over one hot key puts all of its rows into one task. Here every key is cut into ordered
blocks: block totals are pre-aggregated, a small table of totals is accumulated per key, and the
exact window runs inside (key, block) only.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.hashing import draw_key
from tracewell.session import cut_lineage


@dataclass(frozen=True)
class Along:
    """Blocks drawn along a number or a timestamp: each key's range is cut at its own quantiles.

    So blocks hold about equally many rows whatever the scale of the values. Equal values share a
    block; reduce rows to distinct values first, or order them by a digest. `blocks` is a power of two.
    """

    value: str
    descending: bool = False
    blocks: int = 1024


def reached(splits: str, value: Column, blocks: int) -> Column:
    """How many splitters of an array in order a value reaches. There are fewer than `blocks`, a power of two."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(blocks.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= value, at + step).otherwise(at))


def drawn_blocks(df: DataFrame, keys: list[str], along: Along, out: str = "_block") -> DataFrame:
    """Add the number of the key's splitters that a value reaches. NULL values are in block 0.

    The rows are read twice: once for the quantiles, which are a mergeable summary of fixed
    precision, and once to be numbered.
    """
    shares = F.array(*[F.lit((i + 1) / along.blocks) for i in range(along.blocks - 1)])
    splits = F.array_distinct(F.percentile_approx(F.col(along.value), shares, 16 * along.blocks)).alias("_splits")
    reach = reached("_splits", F.col(along.value), along.blocks)
    drawn = on_keys(df, df.groupBy(*keys).agg(splits), keys)
    return drawn.withColumn(out, -reach if along.descending else reach).drop("_splits")


def on_keys(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a table with one row per key. A NULL key meets the NULL key; without keys there is one row for all."""
    if not keys:
        # A table of one row.
        return df.join(F.broadcast(per_key), F.lit(True), "left")
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return df.join(per_key.withColumnsRenamed(names), condition, "left").drop(*names.values())


def prefix_sums(df: DataFrame, keys: list[str], block: Column | Along, order: list, sums: dict[str, Column],
                totals: bool = False, inclusive: bool = False) -> DataFrame:
    """Add running sums per key in the given order.

    `block` must not decrease along `order`; `order` has to be unique within a block for
    reproducible results. With `totals` the sum over the whole key is added as `<name>_total`.

    The input is evaluated once and written to the checkpoint folder; rows are shuffled once, by key
    and block. Block totals and the sums inside blocks start from there.
    """
    names = list(sums)
    values = {f"_v_{n}": sums[n] for n in names}
    if isinstance(block, Along):
        work = drawn_blocks(cut_lineage(df.withColumns(values)), keys, block).repartition(*keys, "_block")
    else:
        work = cut_lineage(df.withColumns({"_block": block, **values}).repartition(*keys, "_block"))
    per_block = work.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    # Without keys there is a single row per block, and the number of blocks is fixed by the caller.
    lead = keys or [F.lit(0)]
    before = Window.partitionBy(*lead).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*lead)
    picked = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
    if totals:
        picked += [F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names]
    offsets = per_block.select(*keys, "_block", *picked)
    inside = (Window.partitionBy(*keys, "_block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (
        on_keys(work, offsets, [*keys, "_block"])
        .withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
        .drop("_block", *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])
    )


def seeded_rank(df: DataFrame, id_cols: list[str], seed, keys: list[str] = (), digits: int = 4) -> DataFrame:
    """Add `rank` (1-based, unique within the key) of a seeded shuffle and `n`, the rows per key.

    The digest spreads evenly, so its leading hex digits give balanced blocks.
    """
    keys = list(keys)
    work = df.withColumn("_key", draw_key(seed, *id_cols))
    ranked = prefix_sums(work, keys, F.substring("_key", 1, digits), ["_key", *id_cols],
                         {"rank": F.lit(1)}, totals=True, inclusive=True)
    return ranked.withColumnRenamed("rank_total", "n").drop("_key")
