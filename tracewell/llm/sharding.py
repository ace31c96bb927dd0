"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.ranks import numbered

SHARDS = 24
#: Equal texts form a group; groups that share the leading bits of the digest are cut together, at most 2^16 cells.
DIGEST_DIGITS = 4
#: Bytes that a row takes beside its text.
ROW_BYTES = 8


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts_from_the_end(cells: Column, capacity: Column) -> Column:
    """First cells of the shards that a greedy walk from the last cell back fills; from any cell on, no fewer shards will do."""
    def step(state, cell):
        used = state["used"] + cell["bytes"]
        return F.when(used <= capacity, F.struct(used.alias("used"), cell["cell"].alias("at"), state["starts"].alias("starts"))).otherwise(
            F.struct(cell["bytes"].alias("used"), cell["cell"].alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(F.reverse(cells), start, step)["starts"]


def _cut(cells: Column, capacity: Column, shards: int, starts: Column, even: Column) -> Column:
    """First cells of all shards but the first: cells above the even share stand alone, and the runs between them are cut
    evenly, at `capacity` at the latest and never so early that the rest would not do with the shards left.

    Cells carry `rest`, the bytes from the cell to the end of its run, and whether the run is the last one.
    """
    def share(cell, left):
        return cell["rest"] / F.when(cell["last"], left).otherwise(F.greatest(F.lit(1), F.round(cell["rest"] / even).cast("int")))

    def step(state, cell):
        fits = state["used"] + cell["bytes"] <= capacity
        spare = F.size(F.filter(starts, lambda s: s > cell["cell"])) + 1 <= state["left"] - 1
        full = cell["first"] | (2 * state["used"] + cell["bytes"] > 2 * state["share"])
        close = (state["used"] > 0) & (~fits | (spare & full))
        opens = close | (state["used"] == 0)
        left = state["left"] - close.cast("int")
        return F.struct(F.when(close, cell["bytes"]).otherwise(state["used"] + cell["bytes"]).alias("used"), left.alias("left"),
                        F.when(opens, share(cell, left)).otherwise(state["share"]).alias("share"),
                        F.when(close, F.concat(state["firsts"], F.array(cell["cell"]))).otherwise(state["firsts"]).alias("firsts"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(shards).alias("left"), F.lit(0.0).alias("share"), F.array().cast("array<int>").alias("firsts"))
    return F.aggregate(cells, start, step)["firsts"]


def _in_runs(cells: DataFrame, shards: int) -> DataFrame:
    """The cells with the even share and their runs: what lies between cells above the even share. At most 2^16 rows, so windows over all of them are small."""
    row = cells.agg(F.collect_list("bytes").alias("sizes"), F.sum("bytes").alias("total"))
    # The cap is bound before the cells are walked, or it would be worked out anew for each cell.
    capped = lambda most: _let(most, lambda top: F.ceil(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + F.least(x, top)) / shards))
    # Large cells count as the mean, and once more as the share that this leaves.
    row = row.withColumn("even", F.greatest(F.lit(1), capped(capped(F.ceil(F.col("total") / shards)))))
    big = (F.col("bytes") > F.col("even")).cast("int")
    upto = Window.orderBy("cell")
    # From the last cell back: a frame that ends with the run would be summed up anew for each cell.
    numbered_ = cells.join(F.broadcast(row.select("even")), F.lit(True)).withColumn("run", 2 * F.sum(big).over(upto) - big)
    return numbered_.select("cell", "bytes", "even", F.sum("bytes").over(Window.partitionBy("run").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)).alias("rest"),
                            (F.col("run") == F.max("run").over(Window.partitionBy())).alias("last"),
                            F.coalesce(F.lag("run").over(upto) != F.col("run"), F.lit(True)).alias("first"))


def _shards_needed(cells: Column, capacity: Column) -> Column:
    def step(state, cell):
        used = state["used"] + cell["bytes"]
        return F.when(used <= capacity, F.struct(used.alias("used"), state["n"].alias("n"))).otherwise(
            F.struct(cell["bytes"].alias("used"), (state["n"] + 1).alias("n")))

    return F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("n")), step)["n"]


def first_cells(cells: DataFrame, shards: int) -> DataFrame:
    """One row: the first cells of shards 1, 2, ... for the least capacity that `shards` shards can do with. Within that
    capacity, shards are cut near an even share of the bytes.

    `cells` has an int `cell` and its `bytes`, at most 2^16 rows, so they fit in one array. No capacity below the
    largest cell or the mean serves; the larger of the two plus the largest cell always does, as every closed shard
    then holds the mean or more. The binary search between them takes as many rounds as the largest cell has bits.
    """
    row = _in_runs(cells, shards).agg(F.sort_array(F.collect_list(F.struct("cell", "bytes", "rest", "last", "first"))).alias("cells"), F.max("even").alias("even"),
                    F.coalesce(F.max("bytes"), F.lit(0)).alias("most"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    low = F.greatest(F.col("most"), F.ceil(F.col("total") / shards))

    def narrow(bounds, _):
        def halve(middle):
            return F.when(_shards_needed(F.col("cells"), middle) <= shards,
                          F.struct(bounds["low"].alias("low"), middle.alias("high"))).otherwise(
                F.struct((middle + 1).alias("low"), bounds["high"].alias("high")))
        return _let(F.floor((bounds["low"] + bounds["high"]) / 2), halve)

    rounds = F.sequence(F.lit(0), F.length(F.bin("most")))
    searched = F.aggregate(rounds, F.struct(low.alias("low"), (low + F.col("most")).alias("high")), narrow)
    cells, even = F.col("cells"), F.col("even")
    cut = lambda capacity: _let(_starts_from_the_end(cells, capacity), lambda starts: F.struct(
        capacity.alias("capacity"), _cut(cells, capacity, shards, starts, even).alias("firsts")))
    return row.select(_let(searched["high"], cut).alias("found")).select("found.*")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids with size, shard and slot; equal texts share a shard, and the largest shard is as small as can be, the others
    as even as that allows.

    The order of the groups is the order of their digests, so a shard is a range of digests. Returns `id_col`, `size`
    (UTF-8 bytes of the text plus 8), `text_crc32`, `shard` and `slot` (gapless from 0 in the shard). A null text
    counts as an empty one; repeated rows get slots of their own; other columns are not read. No rows give no rows.
    Texts are read twice and never shuffled: once for the sums of the cells, once for the narrow rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGEST_DIGITS), 16, 10).cast("int").alias("__cell"))
    cells = rows.groupBy(F.col("__cell").alias("cell")).agg(F.sum("size").alias("bytes"))
    firsts = first_cells(cells, shards).first()["firsts"]
    shard_of_cell = sum(((F.col("__cell") >= c).cast("int") for c in firsts or ()), F.lit(0))
    placed = rows.select(id_col, "size", "text_crc32", shard_of_cell.alias("shard"))
    return numbered(placed, ["shard"], [id_col, "text_crc32", "size"], "slot")
