"""Language models, rules, encoding and the classifiers against plain versions."""

import gc
import hashlib
import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from cases import rows
from corpus_pipeline import quality_rules
from tracewell.llm import bpe, language, near, nnpu, packing, pairs, ppm, quality, repetition, toxicity
from tracewell.llm.common import id_remainder, table
from tracewell.llm.queries import op3

SF = "/root/testdata/sf0.001"


def test_common_prefixes_against_all_pairs():
    def longest(ids):
        out = [0] * len(ids)
        for i in range(len(ids)):
            for j in range(len(ids)):
                k = 0
                while i != j and max(i, j) + k < len(ids) and ids[i + k] == ids[j + k]:
                    k += 1
                out[i] = max(out[i], k)
        return out

    for seed in range(200):
        r = random.Random(seed)
        docs = [[r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(25))] for _ in range(r.randrange(5))]
        got = repetition.common_prefixes(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs], np.int64))
        assert got.tolist() == [x for d in docs for x in longest(d)]


def plain_rules(text):
    text = text or ""
    words = text.encode().split()
    threes, repeat = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if threes[tuple(words[i:i + 3])] > 1:
            repeat |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), failed


def test_rules(odd, none):
    got = repetition.repetition(odd)
    assert set(got.columns) == {*odd.columns, "repetition"} and repetition.repetition(none).count() == 0
    found = got.select("text", "repetition.*").collect()
    assert len(found) == len(rows())
    for r in found:
        assert tuple(r[1:6]) + (r.base_failed,) == plain_rules(r.text)
        assert r.kept == (not r.base_failed and r.n_covered <= 0.5 * r.n_words and r.longest_repeat <= 100)


def test_covered_fraction_decides_in_query_and_pipeline(spark, tmp_path):
    clean = " ".join(f"c{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(60))
    half = " ".join(f"h{i}" for i in range(147))
    covered = f"{passage} {half} {passage}"
    spark.createDataFrame([(1, clean), (2, covered)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op3(spark, str(tmp_path)).collect()}
    assert got[1].kept and not got[2].kept
    assert not got[2].base_failed and got[2].longest_repeat == 60 and got[2].n_covered == 120 and got[2].n_words == 267
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in quality_rules(spark, docs, "").collect()] == [1]


def test_bpe_like_the_library(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(odd, path), path).select("text", "ids", "decoded").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    for r in bpe.digests(odd.withColumn("copy", F.col("text")), path, id_col="copy").collect():
        ids = np.array(library.encode(r.copy or "", add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.copy or "").encode()).hexdigest())
    assert bpe.digests(none, path).count() == 0


@pytest.mark.parametrize("letters", ["ab", "aaab", "the in on", "日本語の", "ñóúaen ", "0123456789"])
def test_speculation_equals_exact_merging(letters):
    merges = bpe.codec_of(open(public_tokenizers.path("byte_bpe_50k.json")).read()).merges
    r = random.Random(letters)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))).encode() for _ in range(2000)]
    ids, counts, failed = merges.speculate(words)
    exact, sizes = merges.exact(words)
    assert (ids == exact).all() and (counts == sizes).all() and 0 < failed < len(words)
    assert isinstance(merges, pairs.Merges)


def plain_ppm(train, depth):
    counts = Counter()
    for t in train:
        line = bytes([ppm.START]) * depth + t + bytes([ppm.END])
        for i in range(depth, len(line)):
            for k in range(depth + 1):
                counts[line[i - k:i], line[i]] += 1
    follow = {}
    for (c, s), n in counts.items():
        follow.setdefault(c, {})[s] = n

    def score(t):
        line, total = bytes([ppm.START]) * depth + t + bytes([ppm.END]), 0.0
        for i in range(depth, len(line)):
            excluded = set()
            for k in range(depth, -1, -1):
                own = {s: n for s, n in follow.get(line[i - k:i], {}).items() if s not in excluded}
                if not own:
                    continue
                n = sum(own.values())
                if line[i] in own:
                    total += math.log10((2 * own[line[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(own) / (2 * n))
                excluded |= own.keys()
            else:
                total -= math.log10(ppm.ALPHABET - len(excluded))
        return total
    return score


def test_partial_matching_against_a_plain_trie(odd, none):
    trained = F.col("doc_id") % 3 != 1
    got = ppm.score(odd.withColumn("copy", F.col("text")), trained, id_col="copy", block_bytes=4000).collect()
    texts = [(r[0], (r[1] or "").encode().lower()) for r in rows()]
    train = [t for i, t in texts if i is not None and i % 3 != 1]
    score, words = plain_ppm(train, ppm.DEPTH), Counter(w for t in train for w in t.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    assert len(got) == len(texts)
    for r in got:
        t = (r.copy or "").encode().lower()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t.split()) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.score == pytest.approx(score(t), rel=1e-5) and r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t.split()) + 1, sum(w in words for w in t.split()) + 1, n)
    assert ppm.score(none, F.lit(True)).count() == 0
    untrained = ppm.score(odd.where("doc_id = 4"), F.lit(False)).first()
    assert untrained.score == pytest.approx(-math.log10(ppm.ALPHABET) * (len(rows()[4][1]) + 1), rel=1e-5)


def test_gram_codes_are_read_in_one_pass():
    raw = [b"", b"a", "\u00e9t\u00e9 ab".encode(), b"", b"x" * 9]
    codes, sizes = ppm.gram_codes(raw)
    lines = [bytes([ppm.START]) * ppm.DEPTH + t + bytes([ppm.END]) for t in raw]
    assert sizes.tolist() == [len(t) + 1 for t in raw] and codes.dtype == np.uint64
    assert codes.tolist() == [int.from_bytes(x[i - ppm.DEPTH:i + 1], "little") for x in lines for i in range(ppm.DEPTH, len(x))]
    assert [len(c) for c in ppm.gram_codes([])] == [0, 0]
    long = [b"some words of a text " * 500] * 40
    tracemalloc.start()
    ppm.gram_codes(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, long))


def plain_kneser_ney(texts):
    """Probability of a character after three others, from definitions."""
    def line(t):
        out = [0, 0, 0]
        for c in t:
            c = ord(c.lower()) if c.isalpha() else 0
            if c or out[-1]:
                out.append(c)
        return out
    tops = Counter(tuple(x[i - 3:i + 1]) for x in map(line, texts) for i in range(3, len(x)))
    tables = [tops]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))

    def p(gram):
        if not gram:
            return 1 / 0x10FFFF
        counts = tables[4 - len(gram)]
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        mine = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not mine:
            return p(gram[1:])
        return max(counts.get(gram, 0) - d, 0) / sum(mine.values()) + d * len(mine) / sum(mine.values()) * p(gram[1:])
    return lambda t: -sum(math.log(p(tuple(x[i - 3:i + 1]))) for x in [line(t)] for i in range(3, len(x))) / (len(line(t)) - 3)


def test_kneser_ney_against_definitions(spark, odd, none, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATION", 1 << 40)
    texts = {"aa": ["the cat sat on the mat", "a cat and a hat", "the end"], "bb": ["le chat est sur la table", "où est la gare", "la fin"]}
    docs = spark.createDataFrame([(i, t, lang) for lang in texts for i, t in enumerate(texts[lang])], "doc_id long, text string, lang string")
    model = language.fit(docs)
    entropy, _, _ = model.entropies([b"the hat", "où est le chat".encode(), b"zzz q"])
    for i, lang in enumerate(("aa", "bb")):
        plain = plain_kneser_ney(texts[lang])
        assert entropy[:, i] == pytest.approx([plain("the hat"), plain("où est le chat"), plain("zzz q")])
    found = {r.text: r.language for r in language.identify(odd, model).select("text", "language").collect()}
    assert found[None].lang == found[""].lang == found["12 34 !!! ###"].lang == "und" and found[None].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(none, model).count() == 0
    assert {r.language.lang for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_language_of_held_out_texts(spark):
    docs = table(spark, SF, "documents")
    found = language.identify(docs, language.fit(docs, ~id_remainder("doc_id", 4, 2))).where(id_remainder("doc_id", 4, 2))
    assert found.where("language.lang = lang").count() >= 0.95 * found.count()


def test_risk_prior_and_fit():
    r = np.random.RandomState(0)
    y = r.uniform(size=4000) < 0.3
    x = (r.uniform(size=(4000, 3)) < np.where(y[:, None], 0.8, 0.1)).astype(np.float32)
    pos = x[y][:300]
    w, _ = nnpu.fit(pos, x, None)
    assert nnpu.class_prior(x[y][300:600] @ w, x @ w) == pytest.approx(0.3, abs=0.07)
    w, b = nnpu.fit(pos, x, 0.3)
    assert ((x @ w + b > 0) == y).mean() > 0.93
    up, down = nnpu.risk(np.array([0.0]), np.array([0.0]), 0.25)
    assert (up, down) == pytest.approx((0.25 * math.log(2), 0.75 * math.log(2)))


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers(spark, odd, none, kind):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    trusted = ~id_remainder("doc_id", 3, 1)
    if kind == "toxicity":
        fitted = toxicity.fit(docs, labels, trusted)
        use, nothing = (lambda d: toxicity.score(d, *fitted, out="p")), toxicity.fit(none, labels)
        empty = toxicity.score(odd, *nothing, out="p")
        truth = "toxic"
    else:
        fitted = quality.fit(docs, labels, trusted)
        use, empty, truth = (lambda d: quality.score(d, fitted, out="p")), quality.score(odd, quality.fit(none, labels), out="p"), "quality"
    found = use(docs).where(~trusted).join(labels, "doc_id").select(truth, "p").collect()
    by = {y: [r.p for r in found if r[truth] == y] for y in (0, 1)}
    better = np.mean([a > b or 0.5 * (a == b) for a in by[1] for b in by[0]])
    assert better > 0.75 and np.mean([p >= 0.5 for p in by[0]]) < 0.2
    scored = use(odd)
    assert set(scored.columns) == {*odd.columns, "p"} and scored.count() == len(rows())
    assert scored.where("p IS NULL OR p < 0 OR p > 1").count() == 0 and use(none).count() == 0
    assert scored.where("text IS NULL OR text = ''").select("p").distinct().count() == 1
    assert empty.where("p BETWEEN 0 AND 1").count() == len(rows())


def test_rare_languages_are_learned(spark):
    for n in range(1, 6):
        rows_ = [(i, f"the cat sat on the mat and the dog number {i} ran", "en") for i in range(40)] + [(100 * n + i, "der hund lief und die katze", "de") for i in range(2)] + [(7, "12 !", "xx")]
        model = language.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), max_chars=300)
        assert {"de", "en"} <= set(model.languages)


@pytest.mark.parametrize(("file", "n"), [("byte_bpe_50k.json", 1_000_000), ("word_bpe_49k.json", 30_000)])
def test_a_very_long_word_is_merged_like_the_library(file, n):
    r = random.Random(n)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/" if n > 10**5 else "abcdefghijklmnopqrstuvwxyz"
    word = "".join(r.choice(letters[:64]) for _ in range(n // 2)) + "aab" * (n // 6)
    merges = pairs.Merges(open(public_tokenizers.path(file)).read())
    began = time.perf_counter()
    ids, counts = merges.exact([b"ab", word.encode(), b"b"])
    assert time.perf_counter() - began < (40 if n > 10**5 else 5)
    small, sizes = merges.exact([b"ab", b"b"])
    assert ids.tolist()[:sizes[0]] == small.tolist()[:sizes[0]] and counts.tolist()[::2] == sizes.tolist()
    if n < 10**5:
        whole, some = merges._merged([word.encode()])
        assert whole.tolist() == ids[counts[0]:counts[0] + counts[1]].tolist()
    else:
        library = Tokenizer.from_file(public_tokenizers.path(file))
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        assert library.encode(word, add_special_tokens=False).ids == ids[counts[0]:counts[0] + counts[1]].tolist()


@pytest.mark.parametrize("kind", ["repetition", "near", "packing", "bpe", "quality"])
def test_numbered_words_are_freed_without_the_garbage_collector(kind):
    raw = [b"the cat sat on the mat", b"", b"the dog, 12 cats"]
    if kind == "packing":
        tokens = packing.WordTokens(open(public_tokenizers.path("word_bpe_49k.json")).read())
    elif kind == "bpe":
        codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    shapes = quality.Shapes()

    def use():
        if kind == "repetition":
            repetition.measure(raw, 5)
        elif kind == "near":
            near.shingles(raw, near.new_words())
        elif kind == "packing":
            tokens.encode(raw, 2)
            tokens.forget()
        elif kind == "bpe":
            codec.encode([t.decode() for t in raw])
            codec.forget()
        else:
            shapes.measure(raw)
            shapes.forget()

    use()
    gc.collect()
    gc.disable()
    try:
        alive = lambda: sum(isinstance(o, defaultdict) for o in gc.get_objects())
        before = alive()
        for _ in range(5):
            use()
        assert alive() == before
    finally:
        gc.enable()


def test_a_worker_keeps_no_tokenizer_after_packing(spark):
    docs = table(spark, SF, "documents").coalesce(1)

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(o, packing.WordTokens) for o in gc.get_objects())])], names=["n"])

    for _ in range(2):  # the worker of the one task takes the next one
        assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count() > 0
        assert spark.range(1, numPartitions=1).mapInArrow(kept, "n long").first()["n"] == 0
