"""Text edits and text features as column expressions; whole texts, no Python per row."""

import os
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell import constants as K
from tracewell.functions.hashing import draw_index
from tracewell.functions.scalars import let, strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def _splice(text: Column, pos: Column, length: Column, new) -> Column:
    """Replace `length` characters at the 1-based position `pos`."""
    new = new if isinstance(new, Column) else F.lit(new)
    return F.concat(F.substr(text, F.lit(1), pos - 1), new, F.substr(text, pos + length))


# ---------------------------------------------------------------- edits

def lexical_style(text, style, tables=K.LEXICAL_STYLES) -> Column:
    """Rewrite a note in the wording of its style; an unknown style leaves the text as it is."""
    text, style = _c(text), _c(style)
    out = F.when(style == K.STRUCTURED_STYLE, structured_style(text))
    for name, table in tables.items():
        rewritten = text
        for phrase, short in table.items():
            rewritten = F.regexp_replace(rewritten, "(?iu)" + _quote(phrase), short.replace("$", r"\$"))
        out = out.when(style == name, rewritten)
    return out.otherwise(text)


def structured_style(text) -> Column:
    """Sentences and clauses joined by semicolons."""
    parts = F.split(strip(text), r"(?<=[.;])\s+")
    kept = F.filter(parts, lambda p: strip(p) != "")
    return F.concat(F.array_join(F.transform(kept, lambda p: F.regexp_replace(p, "[.;]+$", "")), "; "), F.lit("."))


def remove_evidence(text, span, sentence=K.REMOVED_SENTENCE, fallback=K.REMOVED_NOTE) -> Column:
    """Struct(text, removed): the span's first occurrence becomes a neutral sentence."""
    text, span = _c(text), F.coalesce(_c(span), F.lit(""))
    pos = F.when(span != "", F.instr(text, span)).otherwise(F.lit(0))
    return F.struct(
        F.when(pos > 0, _splice(text, pos, F.char_length(span), sentence)).otherwise(F.lit(fallback)).alias("text"),
        (pos > 0).alias("removed"),
    )


def find_cue(text, cues=K.TEMPORAL_CUES) -> Column:
    """First cue of the list that occurs in the text, or NULL."""
    lowered = F.lower(_c(text))
    return F.coalesce(*[F.when(F.instr(lowered, F.lit(c.lower())) > 0, F.lit(c)) for c in cues])


def mask_cue(text, cues=K.TEMPORAL_CUES, token=K.MASK_TOKEN, notice=K.MASK_NOTICE) -> Column:
    """Struct(text, masked): the first listed cue found is masked once, else a notice is appended."""
    text = _c(text)
    cue = find_cue(text, cues)
    pos = F.instr(F.lower(text), F.lower(cue))
    masked = F.when(cue.isNotNull(), _splice(text, pos, F.char_length(cue), token))
    return F.struct(
        F.coalesce(masked, F.concat(text, F.lit(notice))).alias("text"),
        cue.isNotNull().alias("masked"),
    )


def contradict(text, clause=K.CONTRADICTION_CLAUSE) -> Column:
    return F.concat(_c(text), F.lit(clause))


def remove_and_contradict(text, span, clause=K.REMOVED_CONTRADICTION_CLAUSE) -> Column:
    edit = remove_evidence(text, span)
    return F.struct(F.concat(edit["text"], F.lit(clause)).alias("text"), edit["removed"].alias("removed"))


def insert_clause(text, clause) -> Column:
    """Struct(text, start, end): put a clause before the last sentence; offsets are half-open."""
    text = _c(text)
    clause = clause if isinstance(clause, Column) else F.lit(clause)
    n = F.char_length(text)
    back = F.instr(F.reverse(F.substr(text, F.lit(1), n - 1)), F.lit("."))
    cut = F.when(back > 0, n - 1 - back).otherwise(n - 1)
    start = cut + 1
    return F.struct(
        F.concat(F.substr(text, F.lit(1), cut), F.lit("."), clause, F.substr(text, cut + 2)).alias("text"),
        start.cast("int").alias("start"),
        (start + F.char_length(clause)).cast("int").alias("end"),
    )


def mask_ranges(text, ranges, placeholder=K.REDACTED) -> Column:
    """Replace [start, end) ranges by a placeholder, from right to left."""
    text, ranges = _c(text), _c(ranges)
    ordered = F.array_sort(ranges, lambda a, b: b["start"] - a["start"])
    return F.when(ranges.isNull(), text).otherwise(
        F.aggregate(ordered, text, lambda acc, r: _splice(acc, r["start"] + 1, r["end"] - r["start"], placeholder))
    )


def natural_variant(text) -> Column:
    """Everyday spelling of a template note."""
    return F.replace(F.replace(_c(text), F.lit("intravenous"), F.lit("IV")), F.lit("day"), F.lit("hospital day"))


# ---------------------------------------------------------------- perturbations

def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _chosen(candidates: Column, seed: Column, k: Column) -> Column:
    """k members of an index array, drawn without replacement by hash order."""
    def least(drawn: Column) -> Column:
        n = F.least(k, F.size(drawn))
        # Only the structs up to the n-th hash are sorted.
        last = F.get(F.sort_array(F.transform(drawn, lambda d: d["h"])), n - 1)
        near = let(last, lambda top: F.sort_array(F.filter(drawn, lambda d: d["h"] <= top)))
        return F.transform(F.slice(near, F.lit(1), n), lambda d: d["i"])

    return let(F.transform(candidates, lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i"))), least)


def _swap_words(text: Column, table: dict, seed: Column, k: Column) -> Column:
    core = lambda w: F.lower(F.btrim(w, F.lit(".,")))
    known = F.array(*[F.lit(w) for w in table])
    swap = lambda w: F.concat(F.try_element_at(_lookup(table), core(w)), F.substr(w, F.char_length(core(w)) + 1))
    flagged = lambda words: F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(known, core(w)), i)))
    swapped = lambda words, chosen: F.transform(words, lambda w, i: F.when(F.array_contains(chosen, i), swap(w)).otherwise(w))
    return let(F.split(strip(text), r"\s+"), lambda words: let(
        _chosen(flagged(words), seed, k), lambda chosen: F.array_join(swapped(words, chosen), " ")))


def _ocr_noise(text: Column, seed: Column, k: Column) -> Column:
    known = [v for c in K.OCR_CONFUSABLES for v in (c, c.upper())]
    noisy = lambda c: F.try_element_at(_lookup(K.OCR_CONFUSABLES), F.lower(c))
    flagged = lambda chars: F.array_compact(F.transform(chars, lambda c, i: F.when(c.isin(known), i)))
    # One character takes the place of one, so the other places stay as they are.
    change = lambda acc, i: _splice(acc, i + 1, F.lit(1), noisy(F.substr(acc, i + 1, F.lit(1))))
    return let(_chosen(flagged(F.split(text, "")), seed, k), lambda chosen: F.aggregate(chosen, text, change))


def _insert_tokens(text: Column, seed: Column, k: Column) -> Column:
    words = F.split(strip(text), r"\s+")
    fillers = F.array(*[F.lit(f) for f in K.FILLERS])

    def put(acc, step):
        n = F.size(acc)
        at = F.pmod(F.xxhash64(seed, step, F.lit("at")), n - 1) + 2
        word = F.element_at(fillers, (F.pmod(F.xxhash64(seed, step, F.lit("word")), F.lit(len(K.FILLERS))) + 1).cast("int"))
        return F.when(n < 2, acc).otherwise(F.array_insert(acc, at.cast("int"), word))

    return F.array_join(F.aggregate(F.sequence(F.lit(1), k), words, put), " ")


def perturb(text, kind, k, seed) -> Column:
    """One of four surface perturbations at no more than `k` positions drawn from `seed`."""
    text, kind = _c(text), _c(kind)
    k = k if isinstance(k, Column) else F.lit(k)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return (
        F.when(kind == "abbreviation_swap", _swap_words(text, K.ABBREVIATIONS, seed, k))
        .when(kind == "ocr_noise", _ocr_noise(text, seed, k))
        .when(kind == "token_insertion", _insert_tokens(text, seed, k))
        .when(kind == "synonym_substitution", _swap_words(text, K.SYNONYMS, seed, k))
        .otherwise(text)
    )


def sample_perturbation(key: Column, budget: int = 2, kinds=K.PERTURBATIONS) -> Column:
    """Struct(kind, k) drawn from a digest."""
    names = F.array(*[F.lit(x) for x in kinds])
    return F.struct(
        F.element_at(names, draw_index(key, len(kinds), 0) + 1).alias("kind"),
        (draw_index(key, budget, 1) + 1).alias("k"),
    )


# ---------------------------------------------------------------- features

def marker_hits(text, patterns=K.MARKER_PATTERNS, literals=None, shapes=None) -> Column:
    """Names of the wording families present in the text, sorted.

    A family's pattern is tried only on texts that hold, in lower case, one of the literals, or the shape, of which each of
    its matches holds one.
    A text with one of the letters that match an ASCII letter of other form is tried on all patterns. Other patterns than
    the published ones are tried on all texts unless literals are given with them.
    """
    if literals is None:
        literals, shapes = (K.MARKER_LITERALS, K.MARKER_SHAPES) if patterns is K.MARKER_PATTERNS else ({}, {})
    shapes = shapes or {}

    def hits(t: Column) -> Column:
        def of(name: str) -> Column:
            known, found = literals.get(name, [""]), F.lit(False)
            for literal in known:
                found |= F.contains(t["lower"], F.lit(literal))
            # What all literals begin with is looked for first.
            shared = os.path.commonprefix(known)
            likely = t["folds"] | (F.contains(t["lower"], F.lit(shared)) & found if shared and len(known) > 1 else found)
            if name in shapes:
                literal, shape = shapes[name]
                likely |= F.contains(t["lower"], F.lit(literal)) & t["lower"].rlike(shape)
            return F.when(likely & t["text"].rlike("(?iuU)" + patterns[name]), F.lit(name))

        return F.array_compact(F.array(*[of(n) for n in sorted(patterns)]))

    def read(whole: Column) -> Column:
        folds = F.lit(False)
        for letter in K.FOLDED_LETTERS:
            folds |= F.contains(whole, F.lit(letter))
        return let(F.struct(whole.alias("text"), F.lower(whole).alias("lower"), folds.alias("folds")), hits)

    # The text may be an edit of its own, which is made once.
    return let(_c(text), read)


def new_markers(original, edited, patterns=K.MARKER_PATTERNS) -> Column:
    """Wording families of the edited text that the original does not show."""
    return let(marker_hits(edited, patterns), lambda hits: F.when(F.size(hits) == 0, hits).otherwise(
        F.array_except(hits, marker_hits(original, patterns))))


def explicit_cues(text, pattern=K.EXPLICIT_CUE) -> Column:
    """All temporal cues, in text order."""
    return F.regexp_extract_all(_c(text), F.lit("(?iuU)" + pattern), F.lit(0))


def has_explicit_cue(text, pattern=K.EXPLICIT_CUE_ONCE) -> Column:
    return _c(text).rlike("(?iuU)" + pattern)


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def novel_frac(original, edited) -> Column:
    """Share of the edited text's tokens, with repeats, that the original does not have.

    Texts go to Python in Arrow batches and are cut there; membership is tested against a set, so the work grows with the
    length of the texts. NULL where a text is NULL, which costs nothing.
    """
    def share(old: pa.Array, new: pa.Array) -> pa.Array:
        token, out, last, known = re.compile("[a-z0-9]+"), [], None, set()
        for a, b in zip(old, new):
            if not (a.is_valid and b.is_valid):
                out.append(None)
                continue
            # Attempts on one text follow one another.
            if a.as_py() != last:
                last = a.as_py()
                known = set(token.findall(last))
            words = token.findall(b.as_py())
            out.append(sum(w not in known for w in words) / max(1, len(words)))
        return pa.array(out, pa.float64())

    return F.arrow_udf(share, DoubleType())(F.lower(_c(original)), F.lower(_c(edited)))


def locate_phrase(text, phrase) -> Column:
    """0-based place of a phrase in a text without regard to case, else that of its first word of four letters or more
    that occurs; NULL when nothing does or either is NULL. An empty phrase is at 0."""
    t, p = F.lower(_c(text)), F.lower(_c(phrase).cast("string"))
    whole = F.instr(t, p)
    words = F.regexp_extract_all(p, F.lit("[a-z]{4,}"), F.lit(0))
    places = F.filter(F.transform(words, lambda w: F.instr(t, w)), lambda i: i > 0)
    return F.when(whole > 0, whole - 1).otherwise(F.get(places, F.lit(0)) - 1)


def first_phrase(text, phrases) -> Column:
    """Earliest place of an array of phrases; NULL when none is found."""
    return F.array_min(F.transform(_c(phrases), lambda p: locate_phrase(text, p)))


def length_ratio(original, edited) -> Column:
    return F.char_length(_c(edited)) / F.greatest(F.lit(1), F.char_length(_c(original)))


def day_mentions(text) -> Column:
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit("(?iuU)" + K.DAY_MENTION))


def has_digit(text) -> Column:
    return F.coalesce(_c(text), F.lit("")).rlike(r"\d")


def word_count(text) -> Column:
    trimmed = strip(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, K.WHITE + "+")))
