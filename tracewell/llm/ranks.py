"""Gapless numbers inside groups of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that each group is dealt into.
PARTS = 256


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str, parts: int = PARTS) -> DataFrame:
    """The rows with their number in their group, from 0 without gaps.

    A group is dealt into `parts` pieces by a hash of the order columns; the sizes of the pieces, at most
    `parts` rows a group, are summed up, and each piece is numbered on its own. So a group that holds a
    large part of all rows takes many tasks. Rows that agree in all the order columns are exchangeable.
    """
    keys = [*groups, "__part"]
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts))).repartition(*keys)
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys).count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (dealt.withColumn("__place", place).join(sizes.drop("count"), keys)
            .withColumn(out, F.col("__before") + F.col("__place") - 1).drop("__part", "__place", "__before"))
