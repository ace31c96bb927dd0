"""Readers of notes, facts, predictions, judgments and run folders."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewell import constants as K
from tracewell import schemas
from tracewell.functions.scalars import base_id, parse_bool, to_double


def require_columns(df: DataFrame, columns, name: str = "table") -> DataFrame:
    """The table itself, or an error naming the missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = True) -> DataFrame:
    """CSV whose quoted fields may hold newlines and doubled quotes.

    Files with newlines inside fields are read by one task each, so large inputs should come as many
    files; without such newlines `multi_line=False` lets Spark split them.
    Columns are taken by header name. With a schema, the known columns that the header names are
    typed by it and all others stay text; there is no inference pass over the data.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "quote": '"'}
    raw = spark.read.options(**options).csv(path)
    if schema is None:
        return raw
    known = {f.name: f.dataType for f in schema}
    return raw.select([F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in raw.columns])


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes with mentioned_fact_ids as an array; a blank list is empty.

    `ord` numbers the notes in file order for one split file; with several files, order them by the
    note id first or bring an `ord` column along.
    """
    df = require_columns(read_csv(spark, path, schemas.NOTES), ["note_id", "mentioned_fact_ids"], path)
    ids = F.coalesce(F.from_json("mentioned_fact_ids", "array<string>"), F.array().cast("array<string>"))
    df = df.withColumn("mentioned_fact_ids", ids)
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def read_notes_facts_edges(spark: SparkSession, folder: str, notes="notes.csv", facts="facts.csv",
                           edges="revision_edges.csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, facts and revision edges of one folder; a missing file raises Spark's path error."""
    f = read_csv(spark, f"{folder}/{facts}", schemas.FACTS)
    f = f if "ord" in f.columns else f.withColumn("ord", F.monotonically_increasing_id())
    return read_notes(spark, f"{folder}/{notes}"), f, read_csv(spark, f"{folder}/{edges}", schemas.REVISION_EDGES)


def relation_notes(notes: DataFrame) -> DataFrame:
    """Notes that carry a relation and an evidence span."""
    out = notes.where(F.col("gold_relation").isNotNull() & F.col("gold_evidence_span").isNotNull())
    if "mention_order" not in out.columns:
        out = out.withColumn("mention_order", F.lit("forward"))
    return out


def manipulation_pairs(adversarial: DataFrame, notes: DataFrame) -> DataFrame:
    """Adversarial rows whose base note is a relation note."""
    ids = relation_notes(notes).select(F.col("note_id").alias("base_note_id"))
    return adversarial.join(ids, "base_note_id", "left_semi")


def normalise_predictions(df: DataFrame, score: str = "evidence_score", accept=K.TRUE_WORDS, null_abstains: bool = False,
                          strict_score: bool = False, required=("example_id", "model", "abstained", "correct")) -> DataFrame:
    """Typed predictions: ids as text, boolean abstained, numeric correct and score, base id,
    answered and correct_answered.

    With `strict_score` a row without a numeric score is an error.
    """
    require_columns(df, required, "predictions")
    out = df.withColumns({
        "example_id": F.col("example_id").cast("string"), "model": F.col("model").cast("string"),
        "abstained": parse_bool("abstained", accept, null_as=null_abstains, numeric=True), "correct": to_double("correct"),
        "score": to_double(score) if score in df.columns else F.lit(None).cast("double")})
    if strict_score:
        message = F.lit("a prediction has no numeric score")
        out = out.withColumn("score", F.when(F.col("score").isNull(), F.raise_error(message)).otherwise(F.col("score")))
    if "base_id" not in out.columns:
        out = out.withColumn("base_id", base_id("example_id"))
    return out.withColumns({
        "answered": ~F.col("abstained"),
        "correct_answered": ~F.col("abstained") & F.coalesce(F.col("correct") == 1, F.lit(False))})


def read_predictions(spark: SparkSession, path: str, **options) -> DataFrame:
    return normalise_predictions(read_csv(spark, path), **options)


def with_gold(predictions: DataFrame, gold: DataFrame, strict: bool = True) -> DataFrame:
    """Add the gold relation of the base note (one row per note is kept) and recompute `correct`.

    With `strict` a prediction without gold is an error, raised while the rows are read.
    """
    dim = gold.where(F.col("gold_relation").isNotNull()).groupBy(F.col("note_id").alias("base_id")).agg(
        F.max("gold_relation").alias("gold_relation"))
    out = predictions.drop("gold_relation").join(dim, "base_id", "left")
    if strict:
        message = F.concat(F.lit("no gold relation for "), F.col("example_id"))
        out = out.withColumn("gold_relation", F.when(F.col("gold_relation").isNull(), F.raise_error(message)).otherwise(F.col("gold_relation")))
    hit = F.coalesce((F.col("answer") == F.col("gold_relation")).cast("double"), F.lit(0.0))
    return out.withColumn("correct", F.when(~F.col("abstained"), hit))


def relation_names(answer: Column, relations=K.RELATIONS) -> Column:
    """Class numbers as relation names; names stay as they are."""
    index = answer.cast("string").try_cast("double").cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in relations]), index), answer.cast("string"))


def control_labels(controls: DataFrame) -> DataFrame:
    """Evidence labels of edited notes, the first row per id by content."""
    require_columns(controls, ["note_id", "evidence_available_oracle", "evidence_case"], "controls")
    extra = F.col("contradiction_present_oracle") if "contradiction_present_oracle" in controls.columns else F.lit(0)
    ordered = ["ord"] if "ord" in controls.columns else []
    rows = controls.select(F.col("note_id").cast("string").alias("example_id"), "evidence_available_oracle", "evidence_case",
                           extra.alias("contradiction_present_oracle"), *ordered)
    fields = rows.columns[1:4]
    order = F.struct(*ordered, *fields)
    return rows.groupBy("example_id").agg(F.min_by(F.struct(*fields), order).alias("_f")).select("example_id", "_f.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order, reduced before the shuffle."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record per line; blank and unreadable lines are skipped.

    Adds the place of the record: file, then the line's number within the file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_line"))
    bad = "_corrupt_record"
    parsed = lines.where(F.trim("value") != "").withColumn(
        "_r", F.from_json("value", StructType([*schema.fields, StructField(bad, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    return parsed.where(F.col(f"_r.{bad}").isNull() & F.col("_r").isNotNull()).select("_r.*", "_file", "_block", "_line").drop(bad)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments, the last record per note and condition."""
    schema = StructType(list(schemas.JUDGMENTS.fields))
    rows = read_jsonl(spark, path, schema)
    return last_per_key(rows, ["note_id", "condition"], ["_file", "_block", "_line"]).drop("_file", "_block", "_line")


RUN_FOLDER = r"/([^/]+)_(frozen|unfrozen)_seed(\d+)/"


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Prediction files of run folders `<condition>_<frozen|unfrozen>_seed<k>`; other folders are skipped.

    Of several files of one kind in a folder the first by name counts; `file_kind` is the file name
    up to `_predictions.csv`.
    """
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(pattern)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, RUN_FOLDER, i)
    named = raw.select("*", part(1).alias("condition"), part(2).alias("encoder"), part(3).alias("seed"),
                       F.regexp_extract(path, r"([^/]+)_predictions\.csv$", 1).alias("file_kind"))
    return named.where((F.col("condition") != "") & (F.col("file_kind") != "")).withColumn("seed", F.col("seed").cast("int"))


def first_run_file(runs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Label rows by the kind whose pattern their file name matches, keeping the first file per run."""
    kind = F.coalesce(*[F.when(F.col("file_kind").rlike(p), F.lit(k)) for k, p in kinds.items()])
    rows = runs.withColumn("kind", kind).where(F.col("kind").isNotNull())
    keys = ["condition", "encoder", "seed", "kind"]
    return rows.join(rows.groupBy(*keys).agg(F.min("file_kind").alias("file_kind")), [*keys, "file_kind"], "left_semi")


def read_id_lists(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON arrays of ids, one file `<set>.json` per set, or one folder of that name: long table (set, note_id)."""
    text = spark.read.text(pattern, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json(?:/[^/]*)?$", 1)
    ids = F.from_json("value", "array<string>")
    return text.select(name.alias("set"), F.explode(ids).alias("note_id")).distinct()


def accepted_spans(gold_spans: DataFrame) -> DataFrame:
    return gold_spans.where("reason = 'accepted'").select("note_id", "text", "gold_evidence_span_v2", "validity_tier")
