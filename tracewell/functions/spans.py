"""Character spans and token flags: locating, overlap, recall and Jaccard.

Ranges are arrays of struct<start:int,end:int>, half-open and 0-based.
"""

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tracewell import constants as K
from tracewell.functions.scalars import let, strip

# Ship the Python code with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
RANGES = "array<struct<start:int,end:int>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def make_range(start, end) -> Column:
    return F.struct(_c(start).cast("int").alias("start"), _c(end).cast("int").alias("end"))


def no_ranges() -> Column:
    return F.array().cast(RANGES)


def find_span(text, span) -> Column:
    """0-based position of the first occurrence, -1 when absent, blank or missing."""
    span = _c(span)
    return F.when(span.isNull() | (span == ""), F.lit(-1)).otherwise(F.coalesce(F.instr(_c(text), span), F.lit(0)) - 1)


def span_range(text, span) -> Column:
    """Range of the first occurrence, NULL when absent."""
    at = find_span(text, span)
    return F.when(at >= 0, make_range(at, at + F.char_length(_c(span))))


def alignment_status(text, span, has_label) -> Column:
    return (
        F.when(~_c(has_label), F.lit("no_generator_evidence_label"))
        .when(find_span(text, span) >= 0, F.lit("exact"))
        .otherwise(F.lit("not_exactly_located"))
    )


# ---------------------------------------------------------------- located citations

def _longest_common_run(text: str, span: str) -> tuple[int, int]:
    """Start in the text and length of the longest common substring, earliest in the text.

    The states of the automaton are the substrings of the span, those that end at the same places taken as
    one; the text is read once, and the state is always its longest end that the span has.
    """
    moves, back, longest = [{}], [-1], [0]
    last = 0
    for ch in span:
        new = len(moves)
        moves.append({})
        back.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and ch not in moves[at]:
            moves[at][ch] = new
            at = back[at]
        if at >= 0:
            to = moves[at][ch]
            if longest[to] > longest[at] + 1:
                # The shorter substrings of this state end at more places from now on: they get a state of their own.
                short = len(moves)
                moves.append(dict(moves[to]))
                back.append(back[to])
                longest.append(longest[at] + 1)
                while at >= 0 and moves[at].get(ch) == to:
                    moves[at][ch] = short
                    at = back[at]
                back[to] = short
                to = short
            back[new] = to
        last = new
    state, run, best, end = 0, 0, 0, 0
    for i, ch in enumerate(text, 1):
        while state and ch not in moves[state]:
            state = back[state]
            run = longest[state]
        state = moves[state].get(ch, 0)
        run = run + 1 if state else 0
        if run > best:
            best, end = run, i
    return end - best, best


def locate_spans_fuzzy(df: DataFrame, text_col: str, spans_col: str, min_chars: int = 8, threshold: float = 0.85) -> DataFrame:
    """Add `ranges` and `coverage_chars` for the cited spans of each row.

    A span counts where it occurs verbatim. The few that do not occur are compared in Python and
    count when the longest common run is long enough. Overlapping ranges count twice in the coverage.
    Every row is worked on in place, so rows may repeat an id and no text is shuffled.
    """
    def closest(texts: pa.Array, misses: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), misses.to_pylist()):
            runs = [(m, *_longest_common_run(text, m["span"])) for m in own or []] if text is not None else []
            out.append([{"pos": m["pos"], "start": at, "end": at + n} for m, at, n in runs
                        if n >= threshold * len(m["span"]) and n >= min_chars])
        return pa.array(out, pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

    fields = [StructField(c, IntegerType()) for c in ("pos", "start", "end")]
    # The optimizer copies deterministic functions into filters and would run this one twice.
    compare = F.arrow_udf(closest, ArrayType(StructType(fields))).asNondeterministic()
    text = F.col(text_col)
    # A long enough run leaves out at most `slack` characters on either side, so it contains the
    # middle of the span; only spans whose middle occurs verbatim go on to Python.
    slack = lambda n: n - F.ceil(F.greatest(threshold * n, F.lit(min_chars))).cast("int")
    likely = lambda span, n: (n - 2 * slack(n) <= 0) | (F.instr(text, F.substr(span, slack(n) + 1, n - 2 * slack(n))) > 0)
    cited = F.filter(
        F.transform(F.coalesce(F.col(spans_col), F.array()), lambda raw, i: F.struct(i.cast("int").alias("pos"), strip(raw).alias("span"))),
        lambda c: F.coalesce(F.char_length(c["span"]) >= min_chars, F.lit(False)))
    placed = df.withColumn("_cited", F.transform(cited, lambda c: F.struct(c["pos"].alias("pos"), c["span"].alias("span"), find_span(text, c["span"]).alias("at"))))
    missed = placed.withColumn("_misses", F.filter("_cited", lambda c: (c["at"] < 0) & likely(c["span"], F.char_length(c["span"]))))
    found = missed.withColumn("_close", compare(F.when(F.size("_misses") > 0, text), F.transform("_misses", lambda c: F.struct(c["pos"].alias("pos"), c["span"].alias("span")))))
    exact = F.transform(F.filter("_cited", lambda c: c["at"] >= 0), lambda c: F.struct(
        c["pos"].alias("pos"), c["at"].cast("int").alias("start"), (c["at"] + F.char_length(c["span"])).cast("int").alias("end")))
    both = found.withColumn("_found", F.array_sort(F.concat(exact, F.coalesce("_close", F.array().cast("array<struct<pos:int,start:int,end:int>>")))))
    return both.withColumns({
        "ranges": F.transform("_found", lambda r: make_range(r["start"], r["end"])),
        "coverage_chars": F.aggregate("_found", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"])),
    }).drop("_cited", "_misses", "_close", "_found")


# ---------------------------------------------------------------- overlap

def char_overlap(text, predicted, gold) -> Column:
    """Struct(recall, precision, overlap, predicted_len, gold_len, f1) of two spans of a text.

    All NULL without a gold span in the text. A predicted span that is missing or not in the text
    has recall 0 and no precision.
    """
    text, predicted, gold = _c(text), _c(predicted), _c(gold)
    g, p = find_span(text, gold), find_span(text, predicted)
    gn, pn = F.char_length(gold), F.char_length(F.coalesce(predicted, F.lit("")))
    inter = F.when(p < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(p + pn, g + gn) - F.greatest(p, g)))
    recall, precision = inter / gn, F.when(p >= 0, inter / pn)
    ok = g >= 0
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
    return F.struct(
        F.when(ok, recall).alias("recall"),
        F.when(ok, precision).alias("precision"),
        F.when(ok, inter).alias("overlap"),
        F.when(ok, pn).alias("predicted_len"),
        F.when(ok, gn).alias("gold_len"),
        F.when(ok, f1).alias("f1"),
    )


def covered_length(ranges) -> Column:
    """Characters covered by at least one range, by merging the sorted ranges."""
    ordered = F.array_sort(F.filter(_c(ranges), lambda r: r["end"] > r["start"]))
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("reach"))
    state = F.aggregate(ordered, start, lambda acc, r: F.struct(
        (acc["total"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["reach"]))).alias("total"),
        F.greatest(acc["reach"], r["end"]).alias("reach")))
    return state["total"]


def clip_ranges(ranges, low, high) -> Column:
    return F.transform(_c(ranges), lambda r: F.struct(
        F.greatest(r["start"], low).cast("int").alias("start"), F.least(r["end"], high).cast("int").alias("end")))


def range_recall(gold_start, gold_end, ranges) -> Column:
    """Share of the gold range covered by the ranges; NULL without a gold range."""
    start, end = _c(gold_start), _c(gold_end)
    ok = start.isNotNull() & (start != -1) & (end > start)
    return F.when(ok, covered_length(clip_ranges(ranges, start, end)) / (end - start))


def range_jaccard(a, b, text_len) -> Column:
    """Jaccard index of two sets of characters; 1 when both are empty."""
    n = text_len if isinstance(text_len, Column) else F.lit(text_len)
    a, b = clip_ranges(a, F.lit(0), n), clip_ranges(b, F.lit(0), n)
    joint = covered_length(F.concat(a, b))
    shared = covered_length(a) + covered_length(b) - joint
    return F.when(joint == 0, F.lit(1.0)).otherwise(shared / joint)


def index_jaccard(a, b) -> Column:
    joint = F.size(F.array_union(_c(a), _c(b)))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / joint)


def ranges_overlap_any(a, b) -> Column:
    return let(_c(b), lambda others: F.exists(_c(a), lambda x: F.exists(others, lambda y: F.least(x["end"], y["end"]) > F.greatest(x["start"], y["start"]))))


def injected_spans(spans_json, text) -> Column:
    """Ranges of injected content: the JSON column, else the fixed pattern of older files."""
    raw, text = strip(spans_json), _c(text)
    parsed = F.from_json(raw, "array<struct<type:string,start:int,end:int,clause:string>>")
    usable = ~raw.isin("", "[]") & parsed.isNotNull() & ~F.exists(
        parsed, lambda s: s.isNull() | s["start"].isNull() | s["end"].isNull())
    from_json = F.transform(parsed, lambda s: make_range(s["start"], s["end"]))
    at = F.regexp_instr(text, F.lit(K.FABRICATED_CLAUSE)) - 1
    legacy = F.when(
        at >= 0, F.array(make_range(at, at + F.char_length(F.regexp_extract(text, K.FABRICATED_CLAUSE, 0))))
    ).otherwise(no_ranges())
    return F.when(F.coalesce(usable, F.lit(False)), from_json).otherwise(legacy)


# ---------------------------------------------------------------- tokens

def token_offsets(text, block: int = 64) -> Column:
    """Offsets of whitespace-separated tokens; stands in for offsets supplied by a tokenizer.

    Positions are cumulated over blocks of words first and then inside each block, so that long
    texts do not copy a growing array once per word.
    """
    width = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w) + 1)
    starts = lambda blocks: F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + width(b)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def place(words, start):
        return F.aggregate(
            words, F.struct(start.alias("at"), no_ranges().alias("out")),
            lambda acc, w: F.struct(
                (acc["at"] + F.char_length(w) + 1).alias("at"),
                F.when(w == "", acc["out"]).otherwise(
                    F.array_append(acc["out"], make_range(acc["at"], acc["at"] + F.char_length(w)))).alias("out")))["out"]

    cut = lambda words: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(words) - 1) / block).cast("int")), lambda i: F.slice(words, i * block + 1, F.lit(block)))
    return let(F.split(_c(text), r"\s"), lambda words: let(
        cut(words), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), place))))


def token_labels(offsets, spans) -> Column:
    """1 for tokens that lie inside one of the spans; zero-width tokens are 0."""
    inside = lambda t, all_spans: (t["start"] != t["end"]) & F.exists(
        all_spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"]))
    return let(_c(spans), lambda all_spans: F.transform(
        _c(offsets), lambda t: F.when(inside(t, all_spans), F.lit(1)).otherwise(F.lit(0))))


def longest_flag_run(text, offsets, flags) -> Column:
    """Text of the widest run of flagged tokens, the earliest one on a tie; NULL without a flag."""
    # Most tokens carry no flag and are left out first; a run goes on while the tokens' places follow one another.
    hits = let(_c(flags), lambda marks: F.array_compact(F.transform(_c(offsets), lambda o, i: F.when(
        (F.get(marks, i) > 0) & (o["start"] != o["end"]), F.struct(i.alias("at"), o["start"].alias("s"), o["end"].alias("e"))))))
    init = F.struct(*[F.lit(v).alias(n) for n, v in (("at", -2), ("rs", -1), ("bs", -1), ("be", -1))])

    def step(acc, p):
        rs = F.when(acc["at"] == p["at"] - 1, acc["rs"]).otherwise(p["s"])
        # An open run is only replaced by a strictly wider one, so comparing while it grows is enough.
        better = (p["e"] - rs) > (acc["be"] - acc["bs"])
        return F.struct(
            p["at"].alias("at"), rs.alias("rs"),
            F.when(better, rs).otherwise(acc["bs"]).alias("bs"),
            F.when(better, p["e"]).otherwise(acc["be"]).alias("be"))

    return let(F.aggregate(hits, init, step), lambda best: F.when(
        best["bs"] >= 0, F.substr(_c(text), best["bs"] + 1, best["be"] - best["bs"])))


def token_recall(predicted, gold) -> Column:
    """Share of gold tokens that are flagged; NULL without gold tokens."""
    total = F.aggregate(_c(gold), F.lit(0), lambda a, g: a + g)
    both = F.aggregate(
        F.zip_with(_c(predicted), _c(gold), lambda p, g: F.coalesce(F.when((p > 0) & (g > 0), F.lit(1)), F.lit(0))),
        F.lit(0), lambda a, x: a + x)
    return F.when(total > 0, both / total)


def token_recall_status(reason, gold_span, recall, tier) -> Column:
    """Tier of a scored row, or why it cannot be scored."""
    reason = _c(reason)
    return (
        F.when(reason.isNull(), F.lit("no_v2_row"))
        .when((reason != "accepted") | _c(gold_span).isNull(), reason)
        .when(_c(recall).isNull(), F.lit("gold_span_not_in_truncated_note"))
        .otherwise(_c(tier))
    )


def notice_visible_tokens(n_clean, n_notice, max_len: int = 128) -> Column:
    """Tokens of an appended notice that fit into the window (two positions are reserved)."""
    nc, nn = _c(n_clean), _c(n_notice)
    return F.greatest(F.lit(0), F.least(F.lit(max_len - 2) - (nc - 2), nn - nc))


def notice_visibility(n_clean, n_notice, max_len: int = 128) -> Column:
    share = F.try_divide(notice_visible_tokens(n_clean, n_notice, max_len), _c(n_notice) - _c(n_clean))
    return (
        F.when((share > -0.01) & (share <= 0), F.lit("none"))
        .when((share > 0) & (share <= 0.999), F.lit("partial"))
        .when((share > 0.999) & (share <= 1), F.lit("full"))
    )
