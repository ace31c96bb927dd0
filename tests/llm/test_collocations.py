import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, stands_for=80, top=2000):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        held = {}
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i:i + k]] = max(held.get(g[i:i + k], 0), a)
        found = []
        for g, a in often.items():
            if 100 * held.get(g, 0) >= stands_for * a and g in held:
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(docs, **how):
    return sorted(map(tuple, collocations.collocations(docs, **how).collect()))


@pytest.mark.parametrize(("letters", "least", "top"), [("ab", 3, 2000), ("abcdef", 2, 7), ("ab cd. e,", 4, 2000)])
def test_equals_counting_everything(spark, letters, least, top):
    rng = random.Random(letters)
    rows = [(" ".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) + rng.choice([".", "", " !\n"]), rng.choice(["en", "fr", None])) for _ in range(300)]
    rows += [("One very long Passage without any stop that is copied over and over again", "en")] * 40 + [("x y " * 4000, "fr"), (None, "de"), (" ,\t", "de"), ("É é\x1cé a\x85b", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert got(docs, least=least, top=top) == plainly(rows, least, top=top)


def test_hot_heads_are_dealt_out_and_counted_alike(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(" ".join(f"new york {rng.choice('abcdefgh')}" for _ in range(30)) + f" end{i % 5}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert collocations._salts(docs.select("lang", "text"), 200, 8)["en", b"new", b"york"] > 2
    monkeypatch.setattr(collocations, "PART_BYTES", 2000)
    expected = plainly(rows, 30)
    assert got(docs) == expected
    monkeypatch.setattr(collocations, "HOT_SHARE", 2.0)
    monkeypatch.setattr(collocations, "STEP_BYTES", 300)
    assert got(docs) == expected


def test_paths_join_unbranched_edges_and_give_them_back(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(long, "en")] * 5 + [("w10 w11 w12 w13 q", "en"), ("a a a a a a", "en"), ("b c b c b c b", "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    phrases, totals = collocations.counts(docs, 1)
    phrases.cache()
    paths = collocations.unary_paths(phrases)
    edges = {(tuple(r["phrase"]), r["n"]) for r in phrases.where("size(phrase) = 4").collect()}
    assert {(tuple(r["phrase"]), r["n"]) for r in collocations.windows(paths).collect()} == edges
    runs = {" ".join(r["words"]): r["n"] for r in paths.collect()}
    assert runs[" ".join(f"w{i}" for i in range(13))] == 5 and runs[" ".join(f"w{i}" for i in range(11, 40))] == 5
    assert runs["w10 w11 w12 w13"] == 6 and "w11 w12 w13 q" in runs
    assert [tuple(r) for r in totals.collect()] == [("en", 5 * 40 + 5 + 6 + 7)]


def test_exact_past_64_bits_odd_rows_and_no_rows(spark, odd, none, monkeypatch):
    assert got(none) == []
    rows = [(r["text"], r["lang"]) for r in odd.select("text", "lang").collect()]
    clash = odd.withColumn("n", F.lit(1)).withColumn("head", F.lit("x")).withColumn("salt", F.lit("y"))
    assert got(clash, least=2) == plainly(rows, 2)
    known = spark.createDataFrame([("en", ["a", "b"], 6 * 10**18), ("en", ["a"], 9 * 10**18), ("en", ["b"], 7 * 10**18 + 1)], "lang string, phrase array<string>, n long")
    monkeypatch.setattr(collocations, "counts", lambda texts, least: (known, spark.createDataFrame([("en", 5)], "lang string, n long")))
    assert got(odd) == [("en", 1, "a b", 6 * 10**18, 9 * 10**18, 7 * 10**18 + 1, 5, 2000000 * 6 * 10**18 // (16 * 10**18 + 1))]
