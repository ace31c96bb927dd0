"""The registered queries: each operator over its whole table, with production parameters."""

from pyspark.sql import functions as F

import public_tokenizers

from tracewell.llm import bpe, collocations, infill, language, near, neighbours, packing, ppm, quality, repetition, sharding, toxicity, urls
from tracewell.llm.common import id_remainder, table
from tracewell.llm.registry import query


@query("op1_ppm_score")
def op1(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~id_remainder("doc_id", 7, 2))


@query("op2_kneser_ney_language")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~id_remainder("doc_id", 4, 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", id_remainder("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
                        "language.cross_entropy", "language.rejected")


@query("op3_suffix_repetition")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.repetition(docs, max_covered=repetition.COVERED_LIMIT).select("doc_id", "repetition.*")


@query("op4_shortest_pack_first")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_minimax_shards")
def op6(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_speculative_bpe")
def op5(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_multiprobe_neighbours")
def op7(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_nnpu_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features, model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~id_remainder("doc_id", 5, 0))
    scored = toxicity.score(docs, features, model, out="score")
    return scored.select("doc_id", id_remainder("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_nnpu_quality")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~id_remainder("doc_id", 3, 1))
    scored = quality.score(docs, model, out="score")
    return scored.select("doc_id", id_remainder("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_weighted_minhash")
def op10(spark, sf_dir):
    return near.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_fill_in_middle", """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
     c AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
                  ('0x' || h[17:24])::BIGINT % 100 AS r3, ('0x' || h[25:32])::BIGINT % 100 AS r4 FROM u),
     f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 50 THEN 'plain'
                          WHEN r4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
     p AS (SELECT *, array_to_string(units[1:least(c1, c2)], '') AS a, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
                  array_to_string(units[greatest(c1, c2) + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op12(spark, sf_dir):
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), out="infill")
    text = infill.restored(F.col("infill.form"), F.col("infill.output"))
    return made.select("doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
                       F.sha2(F.col("infill.output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


#: Host, path and whether the rule allows.
URL_RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]


@query("op11_bloom_cascade", """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
     p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
     w AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM w""")
def op11(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, allow boolean")
    return urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "url_filter.*")


@query("op13_collocations", """
WITH piece AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
         SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
     words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
     place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
     size AS (SELECT unnest([1, 2, 3, 4]) AS k),
     f AS (SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS n FROM place, size WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30 OR k = 1),
     total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT * FROM f WHERE k > 1 AND n >= 30),
     held AS (SELECT lang, g[i:i + m - 1] AS g, max(n) AS n FROM (SELECT lang, g, k, n, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
     kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, g) WHERE held.n IS NULL OR 100 * held.n < 80 * c.n),
     cut AS (SELECT lang, g, k, n AS a, unnest(range(1, k)) AS p FROM kept),
     s AS (SELECT cut.lang, cut.g, cut.a, cut.p, x.n AS l, y.n AS r, (2000000::HUGEINT * cut.a // (x.n + y.n))::BIGINT AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:cut.p] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[cut.p + 1:]),
     best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, p) = 1),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, rank, phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))
