"""Quality rules on repeated passages: suffix array and longest common prefixes over the words of each text."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, numbering, release, starts_of, steps, sums, word_ids

#: A word is a run of other bytes than these.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: A repeated passage has so many words at least.
MIN_WORDS = 5
MAX_COVERED = 0.5
#: Text bytes whose suffixes are sorted together.
STEP_BYTES = 1 << 20
MAX_LONGEST = 100
#: The limit of the queries on the words that repeats of MIN_WORDS or more cover. These words lie in repeated windows of
#: three as well, so at the base limit of a half it would decide nothing. Of 3,243 clean documents none has a share over 0.29.
COVERED_LIMIT = 0.35

_TYPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_covered long, longest_repeat long")


def common_prefixes(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the length of the longest passage that starts there and starts again elsewhere in its text.

    Prefix doubling sorts the suffixes of all texts at once; only suffixes whose rank is shared go on to the next
    doubling. The rank of a group is the place of its first suffix, so that the last ranks are the suffix array.
    The ranks of every doubling give the common prefix of neighbours by descent over the powers of two.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _first_of_run(key[order])
    active = _shared(rank, order)
    levels, h = [rank.astype(np.int32)], 1
    while len(active):
        nxt = active + h
        inside = nxt < end[active]
        follow = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        moved, old = active[order], rank[active[order]]
        rank[moved] = old + _first_of_run(key[order]) - _first_of_run(old)
        active = _shared(rank, moved)
        levels.append(rank.astype(np.int32))
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    place = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[place], b[place]
    common = np.zeros(len(place), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        same = (x < end[a]) & (y < end[b])
        same[same] = levels[level][x[same]] == levels[level][y[same]]
        common[same] += 1 << level
    prefix = np.zeros(n + 1, np.int64)
    prefix[place + 1] = common
    longest = np.empty(n, np.int64)
    longest[suffixes] = np.maximum(prefix[:-1], np.append(prefix[1:-1], 0))
    return longest


def _first_of_run(values: np.ndarray) -> np.ndarray:
    new = np.append(True, values[1:] != values[:-1])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _shared(rank: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Those of the members, given in the order of their ranks, whose rank another one has as well."""
    r = rank[members]
    same = r[1:] == r[:-1]
    return members[np.append(same, False) | np.append(False, same)]


def covered(longest: np.ndarray, least: int, width: np.ndarray) -> np.ndarray:
    """Words inside the union of the spans of `width` words that start where the repeat has `least` words or more."""
    at = np.flatnonzero(longest >= least)
    steps_ = np.bincount(at, minlength=len(longest) + 1) - np.bincount(at + width[at], minlength=len(longest) + 1)
    return np.cumsum(steps_)[:-1] > 0


def measure(raw: list[bytes], min_words: int) -> dict[str, np.ndarray]:
    """The measures of a list of texts."""
    words = [t.split() for t in raw]
    ids, counts = word_ids(words, numbering())
    longest = common_prefixes(ids, counts)
    top = np.zeros(len(raw), np.int64)
    full = counts > 0
    if full.any():
        top[full] = np.maximum.reduceat(longest, starts_of(counts)[full])
    texts = [t.decode() for t in raw]
    lines = [[s for s in t.split("\n") if s.encode().split()] if "\n" in t else () for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(s) - len(set(s)) for s in lines], np.int64),
        "n_repeat_words": sums(covered(longest, 3, np.full(len(longest), 3)), counts),
        "n_covered": sums(covered(longest, min_words, longest), counts),
        "longest_repeat": np.where(top >= min_words, top, 0),
    }


def repetition(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED,
               max_longest: int = MAX_LONGEST, out: str = "repetition") -> DataFrame:
    """The rows with a struct `out` of measures and the verdict `kept`.

    Every occurrence of a maximal repeated passage lies in the span that starts at its first word and has the length
    of the longest repeat there, so the union of these spans is the union of the maximal repeats. A text is rejected
    if it has fewer than 50 words, if over half its words lie in repeated three-word windows, if repeats of
    `min_words` or more cover over `max_covered` of its words, or if one has over `max_longest` words.

    Those words lie in repeated three-word windows too, so `max_covered` decides only where it is below a half.

    A null or empty text has no words and is rejected. Repeated rows get equal results; other columns are kept, and
    one named as `out` is replaced. Each text is worked on alone, so nothing is shuffled.
    """
    @F.arrow_udf(_TYPE)
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [measure(raw, min_words) for raw in steps(batch, STEP_BYTES)] or [measure([], min_words)]
            names = list(parts[0])
            release()
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in names], names)

    at = free_name([*docs.columns, out], "__measures")
    m = lambda name: F.col(f"{at}.{name}")
    failed = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    within = (m("n_covered") <= max_covered * m("n_words")) & (m("longest_repeat") <= max_longest)
    measured = docs.withColumn(at, measures.asNondeterministic()(F.col(text_col)))
    return measured.withColumn(out, F.struct(f"{at}.*", failed.alias("base_failed"), (~failed & within).alias("kept"))).drop(at)
