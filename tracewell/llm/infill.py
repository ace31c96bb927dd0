"""Fill-in-the-middle: a text is cut into prefix, middle and suffix between words, and put in another order."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import STEP_BYTES

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that are transformed, and of a hundred of these, those that begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42

#: A unit ends where white space follows a word. No UTF-8 text holds the byte that is put there.
_END_OF_UNIT, _CUT = r"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\xff"


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed, colon and id; a null id is the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(marks: tuple[str, str, str]) -> list[bytes]:
    """The marks in bytes. No mark's first character stands further on in a mark, and none begins another, so what
    precedes or follows a mark never makes a false one with it."""
    firsts = {m[:1] for m in marks}
    if len(marks) != 3 or "" in marks or any(c in m[1:] for m in marks for c in firsts) \
            or any(marks[i].startswith(marks[j]) for i in range(3) for j in range(3) if i != j):
        raise ValueError(f"marks that can be mistaken: {marks}")
    return [m.encode() for m in marks]


def _runs(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of about `limit` bytes; a longer single text makes one of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield slice(start, stop)
        start = stop


def units(texts: pa.Array) -> pa.Array:
    """Lists of units: white space with the word after it, and white space at the end. Joined they are the text."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=_END_OF_UNIT, replacement=b"\\1" + _CUT + b"\\2"), pattern=_CUT)


def pieces(lists: pa.Array, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list of units, cut after `first` and after `last` units."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    ordinal = np.arange(len(flat)) - (np.cumsum(n) - n)[parents]
    role = (ordinal >= first[parents]).astype(np.int8) + (ordinal >= last[parents])
    out = []
    for r, lengths in enumerate((first, last - first, n - last)):
        offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
        own = pa.ListArray.from_arrays(offsets, flat.filter(pa.array(role == r)))
        out.append(pc.binary_join(own, pa.scalar(b"", pa.large_binary())))
    return out


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_binary()) if isinstance(p, bytes) else p for p in (*parts, b"")))


def _arranged(texts: pa.Array, h: list[np.ndarray], marks: list[bytes], rate: int, suffix_first: int) -> dict[str, pa.Array]:
    lists, empty = units(texts), pc.equal(pc.binary_length(texts), 0)
    n = np.where(empty.to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    plain = empty.to_numpy(zero_copy_only=False) | (h[2] % 100 >= rate)
    for m in marks:
        plain |= pc.match_substring(texts, pattern=m).to_numpy(zero_copy_only=False)
    moved = pa.array(~plain)
    cuts = [(x % (n + 1))[~plain] for x in h[:2]]
    prefix, middle, suffix = pieces(lists.filter(moved), np.minimum(*cuts), np.maximum(*cuts))
    p, s, m = marks
    back = pa.array((h[3] % 100 < suffix_first)[~plain])
    order = pc.if_else(back, _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle))
    chars = [pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()) for x in (prefix, middle)]
    nothing = pa.nulls(len(texts), pa.int64())
    form = pc.replace_with_mask(pa.array(["plain"] * len(texts), pa.string()), moved, pc.if_else(back, "spm", "psm"))
    return {"n": pa.array(n), "form": form, "prefix_chars": pc.replace_with_mask(nothing, moved, chars[0]),
            "middle_chars": pc.replace_with_mask(nothing, moved, chars[1]), "output": pc.replace_with_mask(texts, moved, order)}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "infill", seed: int = SEED, rate: int = RATE,
                   suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """`docs` with one more column, the struct `out`: n, form, prefix_chars, middle_chars, output.

    A text is cut into n units, each white space with the word after it, and white space at the end. Of four numbers
    that the id gives with the seed, two cut the units, the third decides whether the text is transformed (`rate` of
    a hundred), the fourth whether the form is spm (suffix, prefix, middle; `suffix_first` of a hundred) or psm.
    Output is what stands behind the marks in that order, or the text itself, form plain.

    A null text counts as empty; empty texts and those that hold a mark are plain, with null lengths. Rows equal in id
    and text have equal results, rows of a null id draw alike. A column named `out` is replaced, others are kept; no
    rows give no rows. Texts are worked on in Arrow batches, some megabytes at a time, without a shuffle.
    """
    raw_marks = _checked(marks)
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_binary())])

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: binary>")
    def arrange(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *h in batches:
            texts, numbers = text.cast(pa.large_binary()), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in h]
            done = []
            for at in _runs(texts):
                own = _arranged(texts[at], [x[at] for x in numbers], raw_marks, rate, suffix_first)
                done.append(pa.StructArray.from_arrays([own[f.name].cast(f.type) for f in kind], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    made = docs.withColumn(out, arrange(text, *draws(id_col, seed)))
    fields = [F.col(f"`{out}`.{f.name}").cast("string" if f.name == "output" else "long" if f.name != "form" else "string").alias(f.name) for f in kind]
    return made.withColumn(out, F.struct(*fields))


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that `fill_in_middle` made this output from, told from form and output alone; null for a null one."""
    _checked(marks)
    any_mark = "|".join(re.escape(m) for m in marks)

    def back(forms: pa.Array, outputs: pa.Array) -> pa.Array:
        moved = pc.fill_null(pc.is_in(forms, pa.array(["psm", "spm"])), False)
        lists = pc.split_pattern_regex(outputs.filter(moved), pattern=any_mark)
        one, two, middle = (pc.list_element(lists, i) for i in (1, 2, 3))
        spm = pc.equal(forms.filter(moved), "spm")
        prefix, suffix = pc.if_else(spm, two, one), pc.if_else(spm, one, two)
        return pc.replace_with_mask(outputs, moved, _joined(prefix, middle, suffix))

    @F.arrow_udf("binary")
    def turn(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for forms, outputs in batches:
            raw = outputs.cast(pa.large_binary())
            filled = pc.fill_null(raw, b"")
            done = [back(forms[at], raw[at]) for at in _runs(filled)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.large_binary())

    return turn(form, output.cast("binary")).cast("string")
