"""Temporal store of relations."""

import datetime
import uuid

from pyspark.sql import functions as F

from catalog.fixtures import view
from catalog.registry import query
from tracewell.operators import store
from tracewell.session import cut_lineage, shared_folder
from tracewell.streaming.contradictions import contradictions

KG_OPEN = ["edge_key", "seq", "source_id", "target_id", "site_id", "relation_type", "valid_from", "coverage"]


@query("k1_event_nodes", """
SELECT SHA256(CONCAT(CAST(user_id AS VARCHAR), '|', event_type, '|event')) AS node_id, user_id AS note_id, event_type AS label,
       MIN(ts) AS created_at, COUNT(*) AS n_mentions FROM {events} GROUP BY user_id, event_type""")
def k1(spark, sf):
    m = view(spark, sf, "events").select(F.col("user_id").alias("note_id"), F.col("event_type").alias("label"), F.lit("event").alias("scale"),
                                         F.col("ts").alias("created_at"), (F.col("user_id") % 5).alias("site_id"))
    return store.resolve_event_nodes(m).select("node_id", "note_id", "label", "created_at", "n_mentions")


@query("k2_contradiction_counts", """
SELECT a.edge_key,
  (SELECT COUNT(*) FROM {f_kg} b WHERE b.source_id = a.source_id AND b.target_id = a.target_id AND b.seq < a.seq
     AND (b.end_seq IS NULL OR b.end_seq > a.seq) AND b.relation_type <> a.relation_type) AS n_contradicts,
  (SELECT COUNT(*) FROM {f_kg} b WHERE b.source_id = a.source_id AND b.target_id = a.target_id AND b.seq > a.seq
     AND (a.end_seq IS NULL OR a.end_seq > b.seq) AND b.relation_type <> a.relation_type) AS n_contradicted_by
FROM {f_kg} a""")
def k2(spark, sf):
    edges = store.supersede(view(spark, sf, "f_kg").select(*KG_OPEN), view(spark, sf, "f_closures"))
    return store.append_relations(edges, block_bits=12).select("edge_key", "n_contradicts", "n_contradicted_by")


@query("k2_contradiction_links", """
SELECT a.edge_key, b.edge_key AS contradicts
FROM {f_kg} a JOIN {f_kg} b ON b.source_id = a.source_id AND b.target_id = a.target_id AND b.seq < a.seq
 AND (b.end_seq IS NULL OR b.end_seq > a.seq) AND b.relation_type <> a.relation_type
WHERE a.edge_key IN (SELECT MAX(edge_key) FROM {f_kg} GROUP BY source_id, target_id)""")
def k2_links(spark, sf):
    edges = view(spark, sf, "f_kg")
    latest = edges.groupBy("source_id", "target_id").agg(F.max("edge_key").alias("edge_key"))
    return store.contradiction_links(edges, latest)


@query("k2_contradictions_on_a_stream", """
SELECT a.edge_key, b.edge_key AS contradicts
FROM {f_kg} a JOIN {f_kg} b ON b.source_id = a.source_id AND b.target_id = a.target_id AND b.seq < a.seq
 AND (b.end_seq IS NULL OR b.end_seq > a.seq) AND b.relation_type <> a.relation_type""")
def k2_stream(spark, sf):
    edges = view(spark, sf, "f_kg")
    rows = edges.select("source_id", "target_id", "edge_key", "relation_type", F.col("seq").alias("at"), F.lit(True).alias("opens")).unionByName(
        edges.where("end_seq IS NOT NULL").select("source_id", "target_id", "edge_key", F.lit(None).cast("string").alias("relation_type"), F.col("end_seq").alias("at"), F.lit(False).alias("opens")))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = cut_lineage(rows)
    # The log comes in three parts, each in a batch of its own.
    cuts = rows.approxQuantile("at", [1 / 3, 2 / 3], 0.01)
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
        rows.where((F.col("at") > low) & (F.col("at") <= high)).write.mode("append").parquet(f"{folder}/log")
        log = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        out = contradictions(log).writeStream.format("parquet").option("path", f"{folder}/links").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("edge_key long, contradicts long").parquet(f"{folder}/links")


@query("k3_supersede", "SELECT edge_key, valid_from, valid_to FROM {f_kg}")
def k3(spark, sf):
    return store.supersede(view(spark, sf, "f_kg").select(*KG_OPEN), view(spark, sf, "f_closures")).select("edge_key", "valid_from", "valid_to")


@query("k4_active_relations", """
SELECT source_id, target_id, relation_type, COUNT(*) AS n FROM {f_kg} WHERE valid_to IS NULL GROUP BY source_id, target_id, relation_type""")
def k4(spark, sf):
    return store.active_relations(view(spark, sf, "f_kg")).groupBy("source_id", "target_id", "relation_type").agg(F.count("*").alias("n"))


@query("k5_audit_trail", """
SELECT k.edge_key, k.source_id, k.target_id, k.relation_type, k.valid_from, k.valid_to FROM {f_kg} k
WHERE (k.source_id, k.target_id) IN (SELECT (source_id, target_id) FROM {f_kg} WHERE relation_type = 'BEFORE')""")
def k5(spark, sf):
    edges = view(spark, sf, "f_kg")
    return store.audit_trail(edges, edges.where("relation_type = 'BEFORE'")).select(
        "edge_key", "source_id", "target_id", "relation_type", "valid_from", "valid_to")


@query("k6_relations_as_of", """
SELECT edge_key, relation_type FROM {f_kg} WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00'
 AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')""")
def k6(spark, sf):
    return store.relations_as_of(view(spark, sf, "f_kg"), datetime.datetime(2024, 1, 15)).select("edge_key", "relation_type")


@query("k6_counts_as_of", """
SELECT p.moment, k.relation_type, COUNT(*) AS n FROM {f_kg} k JOIN (VALUES (TIMESTAMP '2024-01-08 00:00:00'), (TIMESTAMP '2024-01-22 00:00:00')) AS p(moment)
 ON k.valid_from <= p.moment AND (k.valid_to IS NULL OR k.valid_to > p.moment) GROUP BY p.moment, k.relation_type""")
def k6_counts(spark, sf):
    return store.relation_counts_as_of(view(spark, sf, "f_kg"), [datetime.datetime(2024, 1, 8), datetime.datetime(2024, 1, 22)])


# 10,000 moments or as many as the orders give: the day of each order, moved into the weeks of the events.
MOMENTS = "SELECT DISTINCT CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 SECOND * CAST(o_orderkey * 7919 % 4000000 AS INT) AS moment FROM {orders}"


@query("k6_counts_at_points", f"""
WITH m AS ({MOMENTS}), s AS (SELECT relation_type, valid_from AS t, 1 AS d FROM {{f_kg}} WHERE valid_to IS NULL OR valid_to > valid_from
  UNION ALL SELECT relation_type, valid_to, -1 FROM {{f_kg}} WHERE valid_to > valid_from
  UNION ALL SELECT k.relation_type, m.moment, 0 FROM m, (SELECT DISTINCT relation_type FROM {{f_kg}}) k),
w AS (SELECT relation_type, t, SUM(d) OVER (PARTITION BY relation_type ORDER BY t) AS n FROM s)
SELECT DISTINCT t AS moment, relation_type, CAST(n AS BIGINT) AS n FROM w WHERE n > 0 AND t IN (SELECT moment FROM m)""")
def k6_counts_points(spark, sf):
    moments = view(spark, sf, "orders").selectExpr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 4000000) AS moment")
    return store.relation_counts_at(view(spark, sf, "f_kg"), moments)


@query("k6_relations_at_points", """
WITH p AS (SELECT DISTINCT e.user_id AS source_id, e.event_type AS target_id, n.ts AS moment FROM {events} e JOIN {events} n ON n.event_id = e.event_id + 40)
SELECT p.source_id, p.target_id, p.moment, k.edge_key, k.relation_type FROM p JOIN {f_kg} k ON k.source_id = p.source_id AND k.target_id = p.target_id
 AND k.valid_from <= p.moment AND (k.valid_to IS NULL OR k.valid_to > p.moment)""")
def k6_relations_points(spark, sf):
    e = view(spark, sf, "events")
    later = e.select((F.col("event_id") - 40).alias("event_id"), F.col("ts").alias("moment"))
    points = e.select("event_id", F.col("user_id").alias("source_id"), F.col("event_type").alias("target_id")).join(later, "event_id").drop("event_id")
    return store.relations_at(view(spark, sf, "f_kg"), points)


MOTIFS = """
SELECT site_id, COUNT(*) AS n_total_edges, COUNT(*) FILTER (WHERE relation_type = 'ABSTAINED') AS n_abstained,
       AVG(coverage) FILTER (WHERE relation_type <> 'ABSTAINED') AS mean_coverage FROM {f_kg} WHERE valid_to IS NULL GROUP BY site_id"""


@query("k7_site_motifs", f"SELECT site_id, n_total_edges, n_abstained, ROUND(mean_coverage, 6) AS mean_coverage, ROUND(CAST(n_abstained AS DOUBLE) / n_total_edges, 6) AS abstention_rate FROM ({MOTIFS}) m")
def k7(spark, sf):
    return store.site_motifs(view(spark, sf, "f_kg")).withColumns(
        {c: F.round(c, 6) for c in ("mean_coverage", "abstention_rate")})


@query("k7_site_relation_counts", """
SELECT site_id, relation_type, COUNT(*) AS n FROM {f_kg} WHERE valid_to IS NULL AND relation_type <> 'ABSTAINED' GROUP BY site_id, relation_type""")
def k7_counts(spark, sf):
    return store.site_relation_counts(view(spark, sf, "f_kg"))


@query("k8_federate", f"""
SELECT COUNT(*) AS n_sites, CAST(SUM(n_total_edges) AS BIGINT) AS total_edges, CAST(SUM(n_abstained) AS BIGINT) AS total_abstained,
       ROUND(SUM(mean_coverage * (n_total_edges - n_abstained)) / SUM(CASE WHEN mean_coverage IS NOT NULL THEN n_total_edges - n_abstained END), 6) AS population_mean_coverage,
       ROUND(CAST(SUM(n_abstained) AS DOUBLE) / SUM(n_total_edges), 6) AS population_abstention_rate FROM ({MOTIFS}) m""")
def k8(spark, sf):
    return store.federate(store.site_motifs(view(spark, sf, "f_kg"))).withColumns(
        {c: F.round(c, 6) for c in ("population_mean_coverage", "population_abstention_rate")})


@query("k8_federate_counts", "SELECT relation_type, COUNT(*) AS n FROM {f_kg} WHERE valid_to IS NULL AND relation_type <> 'ABSTAINED' GROUP BY relation_type")
def k8_counts(spark, sf):
    return store.federate_counts(store.site_relation_counts(view(spark, sf, "f_kg")))


@query("k11_contradiction_pairs", """
SELECT source_id, target_id, COUNT(*) AS n_active FROM {f_kg} WHERE valid_to IS NULL GROUP BY source_id, target_id
HAVING COUNT(*) > 1 AND COUNT(DISTINCT relation_type) > 1""")
def k11(spark, sf):
    return store.contradiction_pairs(view(spark, sf, "f_kg"))


@query("k11_contradiction_members", """
SELECT edge_key, relation_type FROM {f_kg} WHERE valid_to IS NULL AND (source_id, target_id) IN (
  SELECT (source_id, target_id) FROM {f_kg} WHERE valid_to IS NULL GROUP BY source_id, target_id HAVING COUNT(DISTINCT relation_type) > 1)""")
def k11_members(spark, sf):
    return store.contradiction_members(view(spark, sf, "f_kg")).select("edge_key", "relation_type")


@query("k12_model_disagreements", """
SELECT a.base_id AS note_id, a.answer AS baseline_relation, b.answer AS gated_relation
FROM (SELECT * FROM {f_pred} WHERE variant = 'clean') a FULL JOIN (SELECT * FROM {f_pred} WHERE variant <> 'clean') b ON a.base_id = b.base_id
WHERE a.answer IS DISTINCT FROM b.answer""")
def k12(spark, sf):
    p = view(spark, sf, "f_pred").select("variant", F.col("base_id").alias("note_id"), F.col("answer").alias("relation"))
    return store.model_disagreements(p.where("variant = 'clean'"), p.where("variant <> 'clean'"))
