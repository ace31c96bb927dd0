import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, seed=42, rate=50, spm=80, marks=("<P>", "<S>", "<M>")):
    text, found = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(found) + 1) for x in h[:2])
    if text == "" or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(found), "plain", None, None, text
    pre, mid, suf = ("".join(found[s]) for s in (slice(0, a), slice(a, b), slice(b, None)))
    p, s, m = marks
    return (len(found), "spm", len(pre), len(mid), s + suf + p + pre + m + mid) if h[3] % 100 < spm else (len(found), "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


def made(docs, **how):
    out = infill.fill_in_middle(docs, **how)
    back = infill.restored(F.col("infill.form"), F.col("infill.output"), how.get("marks", infill.MARKS))
    return out.withColumn("back", back)


@pytest.mark.parametrize("how", [{}, {"rate": 100}, {"rate": 100, "suffix_first": 0, "seed": 7, "marks": ("[1]", "{2", "(3)")}])
def test_equals_plain_version_and_is_restored(odd, how):
    got = made(odd.repartition(2), **how).collect()
    kwargs = {"seed": how.get("seed", 42), "rate": how.get("rate", 50), "spm": how.get("suffix_first", 80), "marks": how.get("marks", infill.MARKS)}
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r["infill"]) == plainly(r["doc_id"], r["text"], **kwargs)
        assert r["back"] == (r["text"] or "")
        assert r["source"] == "s" and r["kept"]


def test_marks_in_texts_edges_and_long_texts(spark):
    texts = ["a <P> b", "x<S>", "<M>", "a < b <", "<", "P> <S", " ", "\n\na", "é" * 3000 + " " + "日 本 " * 500, "word " * 300_000, "z" * 2_000_000, "a\x00b \x00", "a\x1cb\x85c d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string").repartition(1)
    for r in made(docs, rate=100).collect():
        assert tuple(r["infill"]) == plainly(r["doc_id"], r["text"], rate=100)
        assert r["back"] == r["text"]


def test_no_rows_clashing_names_and_marks_that_can_be_mistaken(odd, none):
    assert made(none).collect() == []
    clash = odd.withColumnRenamed("source", "infill").withColumn("n", F.lit(1)).withColumn("form", F.lit("x"))
    got = infill.fill_in_middle(clash).select("doc_id", "text", "n", "form", "infill.output").collect()
    assert all(r["n"] == 1 and r["form"] == "x" and r["output"] == plainly(r["doc_id"], r["text"])[4] for r in got)
    for marks in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(odd, marks=marks)
