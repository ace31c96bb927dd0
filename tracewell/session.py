"""Session helpers."""

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`. On a local master without one, as in tests, a
    folder of the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut_lineage` and the number of rows, counted from what was written. An Observation would count in the same job,
    but its manager stays with the session, and tasks of pyspark.ml, which carry the session, cannot be sent then."""
    out = cut_lineage(df)
    return out, out.count()


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input comes in fewer pieces than there are cores.

    For costly work per row on few or small files. Large inputs already have more scan tasks than
    cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
