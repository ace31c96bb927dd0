import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import urls

RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    tail = rest[end:]
    stop = min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def plainly(url, rules):
    host, path = parted(url)
    fits = [(len(h) + len(p), len(h), not allow, h + p) for h, p, allow in ((h.translate(LOWER), p, a) for h, p, a in rules)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], "block" if best and best[2] else "allow"


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/", "http://example.net", "http://example.net?x=/en/", "http://net/", "http://xnet/", "http://.net/a",
        "http://a.net./", "http://fr.org/fr/x#y", "http://org/fr/", "http://a.org/FR/", "ftp://example.com/de/?q", "http://example.com:80/de/", "http://u@example.com/de/", "nonsense", "", None, "://", "://net/",
        "a://b://net/", "http://É.example.net/en/é", "http://a..net//", "http://" + "a." * 5000 + "net/" + "x" * 100_000]


@pytest.mark.parametrize("rules", [RULES, [], [("", "", False)], [("net", "", True), ("net", "", False), ("NET", "/en", True), ("a/b", "/", False), ("org", "fr", False), ("com", "/de/", True)]])
def test_rules_on_odd_urls(spark, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, allow boolean")
    fitting = [r for r in rules if not set(r[0]) & set("/?#") and (not r[1] or r[1].startswith("/"))]
    for r in urls.filtered(pages, table).collect():
        assert tuple(r["url_filter"]) == plainly(r["url"], fitting), r["url"]


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 600])
def test_random_list_in_one_part_and_in_several(spark, max_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd") + rng.choice("xyz")
    hosts = [".".join(word() for _ in range(rng.randint(1, 4))) for _ in range(400)]
    paths = ["/" + "".join(word() + "/" for _ in range(rng.randint(0, 3))) for _ in range(60)]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.random() < 0.4) for _ in range(500)]
    seen = {}
    for h, p, a in rules:
        seen[h, p] = seen.get((h, p), True) and a
    rules = [(h, p, a) for (h, p), a in seen.items()]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a', 'q'])}") for i in range(3000)] + [(9, "http://ax.bx/")] * 1500
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("place", F.lit("mine")).repartition(5)
    got = urls.filtered(frame, spark.createDataFrame(rules, "host string, path string, allow boolean"), max_bytes=max_bytes).collect()
    assert len(got) == len(pages)
    for r in got:
        assert tuple(r["url_filter"]) == plainly(r["url"], rules) and r["place"] == "mine"


def test_cascade_is_exact_for_its_universe_and_alternates(spark):
    keys = np.random.RandomState(3).randint(-2**63, 2**63 - 1, (60_000, 2))
    frame = spark.createDataFrame(keys, ["a", "b"]).select(F.col("a").cast("long"), F.col("b").cast("long"))
    levels = urls.cascade(spark.createDataFrame(keys[:20_000], ["a", "b"]), frame, 40_000)
    assert len(levels) > 3
    assert (urls.member(levels, keys[:, 0].copy(), keys[:, 1].copy()) == (np.arange(60_000) < 20_000)).all()


def test_no_pages_no_rules_and_clashing_names(spark):
    table = spark.createDataFrame(RULES + RULES, "host string, path string, allow boolean")
    none = spark.createDataFrame([], "url string, host int, path int, url_filter int")
    assert urls.filtered(none, table).collect() == []
    one = spark.createDataFrame([("http://a.net/", 1, 2, 3)], none.schema)
    assert urls.filtered(one, table).collect()[0][:3] == ("http://a.net/", 1, 2)
    odd_rules = spark.createDataFrame([(None, None, None), ("net", None, None)], "host string, path string, allow boolean")
    assert tuple(urls.filtered(one, odd_rules).collect()[0]["url_filter"]) == ("a.net", "/", "net", "block")
