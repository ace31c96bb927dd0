"""Writers: reports, id lists, judge inputs and append-only result caches."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalars import content_key
from tracewell.sources.readers import last_per_key, require_columns


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    """Parquet, ORC, CSV or JSON lines; CSV keeps quotes and newlines readable by `read_csv`."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', quoteAll=True)
    writer.save(path)


def nan_as_text(df: DataFrame) -> DataFrame:
    """Report form: missing and non-finite numbers become the text `NaN`."""
    def cell(name, kind):
        c = F.col(name)
        if kind in ("double", "float"):
            gone = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        else:
            gone = c.isNull()
        return F.when(gone, F.lit("NaN")).otherwise(c.cast("string")).alias(name)
    return df.select([cell(n, k) for n, k in df.dtypes])


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A small report as a markdown table; refuses tables that are no reports."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: write the table instead")
    head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + [f"| {' | '.join('--' if v is None else str(v) for v in r)} |" for r in rows])


def write_id_sets(members: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Id sets as one folder per set, in long form."""
    members.write.mode(mode).partitionBy("set").json(path)


def filter_equal(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Rows that satisfy every `column=value`, ignoring case and surrounding blanks."""
    for condition in conditions:
        column, _, value = condition.partition("=")
        require_columns(df, [column])
        df = df.where(F.lower(F.trim(F.col(column).cast("string"))) == value.strip().lower())
    return df


def build_judge_input(notes: DataFrame, removal: DataFrame | None = None, keep: DataFrame | None = None,
                      rerun: DataFrame | None = None, where: list[str] = ()) -> DataFrame:
    """One record per note with a gold relation: clean text, edited texts and tiers.

    `removal` / `keep`: note_id, text, ord, validity_tier; `rerun`: note_id, validity_tier, ord. The last
    row per note counts.
    """
    rows = filter_equal(notes, list(where)).where(F.coalesce(F.trim("gold_relation") != "", F.lit(False)))
    out = rows.select("note_id", F.replace(F.upper(F.trim("gold_relation")), F.lit("_"), F.lit("-")).alias("gold"), F.col("text").alias("clean"))

    def side(df, columns):
        if df is None:
            return None
        last = last_per_key(df.select("note_id", "ord", *columns), ["note_id"], ["ord"])
        return last.select("note_id", *[F.nullif(F.col(c), F.lit("")).alias(n) for c, n in columns.items()])

    parts = [(side(removal, {"text": "silent_removal", "validity_tier": "orig_removal_tier"}), ["silent_removal", "orig_removal_tier"]),
             (side(keep, {"text": "silent_keep"}), ["silent_keep"]), (side(rerun, {"validity_tier": "rerun_tier"}), ["rerun_tier"])]
    for df, names in parts:
        if df is None:
            out = out.withColumns({n: F.lit(None).cast("string") for n in names})
        else:
            out = out.join(df, "note_id", "left")
    return out


def judge_input_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_notes"), F.count("silent_removal").alias("n_removal"), F.count("silent_keep").alias("n_keep"))


def with_content_key(df: DataFrame, model: str, version: str, kind: str = "condition", text: str = "text") -> DataFrame:
    return df.withColumn("key", content_key(F.lit(model), F.lit(version), F.col(kind), F.col(text)))


def cache_misses(tasks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Tasks whose key has no result yet."""
    return tasks.join(cache.select(key), key, "left_anti")


def open_cache(spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = 64) -> str:
    """Name of the cache table in this folder, which is made where it is missing.

    Results are kept in buckets by key, so a lookup sends the tasks to the buckets and reads the key column of
    the cache in place: the cache is never shuffled, however long it gets. The number of buckets belongs to
    the folder; another number is another cache.
    """
    name = "cache_" + hashlib.md5(f"{path}|{key}|{buckets}".encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/buckets={buckets}'")
    return name


def cached_results(spark: SparkSession, tasks: DataFrame, path: str, schema: str, process, key: str = "key", buckets: int = 64) -> DataFrame:
    """Results of the tasks' keys: what the cache lacks is processed once per key, appended, and read with the rest.

    `process` maps missing tasks, one row per key, to result rows of the cache's columns (for example
    `operators.model.apply_model`). Tasks without a key are not processed.
    """
    name = open_cache(spark, path, schema, key, buckets)
    asked = tasks.where(F.col(key).isNotNull()).dropDuplicates([key])
    results = process(cache_misses(asked, spark.table(name), key)).select(*spark.table(name).columns)
    results.write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    spark.catalog.refreshTable(name)
    return spark.table(name).join(asked.select(key), key, "left_semi")


def reusable_records(cache: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Current records, and older ones of which only the judgment of the original note is kept."""
    old = cache.where(F.col("v") != version).select("note_id", "orig_valid", "judge_orig_determinable", "judge_orig_relation")
    return cache.where(F.col("v") == version), old
