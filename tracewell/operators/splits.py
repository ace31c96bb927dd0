"""Seeded splits and samples with exact counts, and training recipes.

Draws follow the digest of the ids, so they are the same on any cluster and partitioning.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.hashing import draw_key
from tracewell.operators.reports import notice_flag
from tracewell.operators.running import on_keys, seeded_rank


def ranked_entities(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct entities with their place in a seeded shuffle."""
    return seeded_rank(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], seed)


def split_labels(df: DataFrame, key: str, test: float = 0.15, dev: float = 0.15, seed: int = 7) -> DataFrame:
    """Split per entity: int(fraction * entities), at least one, for test and development."""
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * test))
    n_dev = F.greatest(F.lit(1), F.floor(F.col("n") * dev))
    split = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_dev, "dev").otherwise("train")
    return ranked_entities(df, key, seed).select(key, split.alias("split"))


def split_by_entity(df: DataFrame, key: str, test: float = 0.15, dev: float = 0.15, seed: int = 7) -> DataFrame:
    """Rows with their split; no entity is in two splits."""
    return df.join(split_labels(df, key, test, dev, seed), key)


def test_entities(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    return bottom_k(df.select(key).where(F.col(key).isNotNull()).distinct(), [], n, [key], seed)


def split_rest(df: DataFrame, key: str, test_ids: DataFrame, n_dev: int, seed: int = 13) -> DataFrame:
    """Fixed test entities; development and training are drawn from the others."""
    test = test_ids.select(key).distinct()
    unknown = test.join(df.select(key), key, "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"test ids without rows in column {key}")
    rest = ranked_entities(df.join(test, key, "left_anti"), key, seed)
    labelled = rest.select(key, F.when(F.col("rank") <= n_dev, "dev").otherwise("train").alias("split"))
    return labelled.unionByName(test.withColumn("split", F.lit("test")))


def bottom_k(df: DataFrame, group: list[str], n: int, id_cols: list[str], seed: int = 7) -> DataFrame:
    """The n rows of least digest of each group, or all where there are fewer.

    Selection, not ranking: rows are counted by the leading digits of their digest, which tells the cell in which the
    n-th row of a group lies. Rows in cells before it are in; those in it, one of some 65,000 parts of the group,
    are ranked, and of these no task sends on more than n a group. What is shuffled does not grow
    with the rows of a group. Rows of equal ids are exchangeable. NULL is a group of its own.
    """
    work = df.withColumn("_key", draw_key(seed, *id_cols)).withColumn("_cell", F.substring("_key", 1, 4))
    cells = work.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    last = cells.where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).select(
        *group, F.col("_cell").alias("_last"), (F.lit(n) - F.col("_before")).alias("_left"))
    placed = on_keys(work, last, group)
    inside = placed.where(F.col("_last").isNull() | (F.col("_cell") < F.col("_last")))
    rank = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_key", *id_cols))
    edge = placed.where(F.col("_cell") == F.col("_last")).withColumn("_rank", rank).where(F.col("_rank") <= n).where(F.col("_rank") <= F.col("_left"))
    return inside.unionByName(edge.drop("_rank")).drop("_key", "_cell", "_last", "_left")


def sample_fraction(df: DataFrame, fraction: float, id_cols: list[str], seed: int = 7) -> DataFrame:
    """max(1, round(fraction * rows)) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return bottom_k(df, [], max(1, round(fraction * df.count())), id_cols, seed)


def sample_per_group(df: DataFrame, group: list[str], n: int, id_cols: list[str], seed: int = 7) -> DataFrame:
    """At most n rows per group."""
    return bottom_k(df, group, n, id_cols, seed)


def sample_n(df: DataFrame, n: int, id_cols: list[str], seed: int = 0) -> DataFrame:
    return bottom_k(df, [], n, id_cols, seed)


def training_parts(controls: DataFrame) -> DataFrame:
    """Add kind and availability: markers with a token, notices on an intact note, silent edits.

    `controls` has variant and masked_cue (boolean); clean notes have the variant `clean`.
    """
    v = F.col("variant")
    kind = (F.when(v == "clean", "clean").when(notice_flag(v, F.col("masked_cue")), "notice_intact")
            .when(v.isin("remove_evidence", "mask_temporal_cue"), "marker_token").otherwise(v))
    return controls.withColumn("part", kind)


def training_recipe(controls: DataFrame, train_entities: DataFrame, key: str, neg_tiers: list[str],
                    recipes: dict[str, list[str]] = K.RECIPES) -> DataFrame:
    """Training rows of every recipe: condition, kind, availability and the row itself.

    Only recipe `E` counts an intact note with a notice as available; the others treat both kinds of
    marker alike.
    """
    rows = training_parts(controls).join(train_entities.select(key).distinct(), key, "left_semi")
    rows = rows.where((F.col("variant") != "silent_removal") | F.col("validity_tier").isin(neg_tiers))
    marker = F.col("part").isin("marker_token", "notice_intact")
    entries = []
    for name, kinds in recipes.items():
        split_markers = "notice_intact" in kinds
        wanted = F.col("part").isin([k for k in kinds if k != "marker"])
        if "marker" in kinds:
            wanted = wanted | marker
        kind = F.when(F.lit(split_markers) & (F.col("part") == "notice_intact"), "notice_intact").when(marker, "marker").otherwise(F.col("part"))
        available = kind.isin("clean", "notice_intact", "silent_keep").cast("int")
        entries.append(F.when(wanted, F.struct(F.lit(name).alias("condition"), kind.alias("kind"), available.alias("available"))))
    return rows.select("*", F.explode(F.array_compact(F.array(*entries))).alias("_r")).select("*", "_r.*").drop("_r", "part")


def recipe_manifest(recipe: DataFrame) -> DataFrame:
    return recipe.groupBy("condition", "kind", "available").agg(F.count("*").alias("n"))
