"""From raw documents to packed training sequences: quality rules, toxicity, near copies, packing."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import near, packing, repetition, toxicity
from tracewell.llm.common import free_name, id_remainder, shared_folder, table
from tracewell.llm.registry import query

#: Documents scored this high or higher are rejected as toxic.
TOXIC = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep; texts that are null, empty or under fifty words go."""
    verdict = free_name(docs.columns, "verdict")
    judged = repetition.repetition(docs, max_covered=repetition.COVERED_LIMIT, out=verdict)
    return judged.where(F.col(f"{verdict}.kept")).select(*docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from labelled ones among them, does not call toxic.

    Without toxic labels all documents stay. A null text has no telling word and stays as well.
    """
    features, model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~id_remainder("doc_id", 5, 0))
    score = free_name(docs.columns, "toxicity")
    return toxicity.score(docs, features, model, out=score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the least id.

    A row is told by its id and the MD5 of its text, so rows of different texts under one id, also a null one, are
    decided on their own. Rows equal in both are copies of one another, of which one at most is the kept one, unless
    they have no words: then each is a group of its own and all stay. Where some go, they are set apart and any one of
    them is taken. A table without such rows has none to set apart, and its texts are joined once.
    """
    md5, digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")), free_name(docs.columns, "text_md5")
    groups = near.near_copies(docs, md5_col="md5").groupBy("doc_id", "md5").agg(F.count_if("kept").alias("n_kept"), F.count("kept").alias("n_rows"))
    kept = groups.where("n_kept > 0").select(F.struct(F.col("doc_id").alias("id"), "md5").alias(digest), "n_kept", "n_rows")
    same = F.col("doc_id").eqNullSafe(F.col(f"{digest}.id")) & (md5 == F.col(f"{digest}.md5"))
    whole, some = (docs.join(kept.where(rule).select(digest), same, "left_semi") for rule in ("n_kept = n_rows", "n_kept < n_rows"))
    return whole.unionByName(some.withColumn(digest, md5).dropDuplicates(["doc_id", digest]).drop(digest))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and offsets. A null text is one end id; repeated rows are packed each; no rows give no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_out), ("near_copies", near_copies_out), ("packing", packed)]
#: SQL states neither the classifier nor the sampling; the stages are tested against plain versions.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each is written to the shared folder and read again.

    Null and empty texts, and those under fifty words, go in the first stage; of repeated rows one stays. Columns of any name are
    kept up to the last stage, which gives pieces. An empty table gives no pieces.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
