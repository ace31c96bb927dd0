"""Normalisers of single values: dirty booleans, ids, relation and tier names, saved JSON answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once.

    An expression used inside a lambda would otherwise be evaluated again for every element, and one
    used several times would be copied into the plan as often.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col) -> Column:
    """Drop surrounding white space of any kind (`trim` drops blanks only)."""
    return F.btrim(_c(col), F.lit(" \t\n\r\f\x0b"))


def parse_bool(col, accept=K.TRUE_WORDS, null_as: bool = False, numeric: bool = False) -> Column:
    """True when the trimmed lower-case text is one of `accept`.

    `null_as` is the value of a missing entry, which differs between producers. With `numeric`
    any number other than zero is true as well (columns stored as numbers).
    """
    text = F.lower(strip(_c(col).cast("string")))
    hit = text.isin(list(accept))
    if numeric:
        hit = hit | F.coalesce(text.try_cast("double") != 0, F.lit(False))
    return F.coalesce(hit, F.lit(null_as))


def to_double(col) -> Column:
    """Number, or NULL when the text is not one."""
    return _c(col).try_cast("double")


def base_id(col, suffixes=K.SUFFIXES) -> Column:
    """Id of the note an edited note derives from."""
    return F.regexp_replace(_c(col), "_(" + "|".join(suffixes) + ")$", "")


def resolve_base_note_id(base, note_id) -> Column:
    """Explicit base id, else the id with `_adv` / `_nat` turned into `_base`."""
    renamed = F.replace(F.replace(_c(note_id), F.lit("_adv"), F.lit("_base")), F.lit("_nat"), F.lit("_base"))
    return F.coalesce(F.nullif(_c(base), F.lit("")), renamed)


def norm_ws(col) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), K.WHITE + "+", " "))


def norm_relation(col, domain=K.RELATIONS) -> Column:
    name = F.replace(F.upper(strip(_c(col).cast("string"))), F.lit("_"), F.lit("-"))
    return F.when(name.isin(list(domain)), name)


def norm_tier(col) -> Column:
    name = F.replace(F.lower(strip(_c(col).cast("string"))), F.lit("-"), F.lit("_"))
    return (
        F.when(name == "strict", F.lit("strict"))
        .when(name.isin("implied", "implied_only"), F.lit("implied_only"))
        .otherwise(F.lit("none"))
    )


def has_injected_content(col) -> Column:
    """Whether a JSON list column holds anything; text that is not JSON counts as content."""
    text = strip(_c(col).cast("string"))
    # Only a JSON array has a length; any other text that parses is not a list.
    length = F.json_array_length(text)
    parses = F.try_parse_json(text).isNotNull()
    return (
        F.when(text.isNull() | text.isin("", "[]", "nan", "None"), F.lit(False))
        .when(length.isNotNull(), length > 0)
        .otherwise(~parses)
    )


def bare_answer(col) -> Column:
    """A saved answer without reasoning blocks and code fences."""
    text = strip(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(text, r"(?m)^```(?:json)?|```$", ""))


def json_object_text(col) -> Column:
    """Outermost `{...}` of a saved answer, after dropping reasoning blocks and code fences."""
    return F.nullif(F.regexp_extract(bare_answer(col), r"(?s)\{.*\}", 0), F.lit(""))


def parse_answer(col, domain=K.RELATIONS) -> Column:
    """Validated fields of a saved extraction answer.

    Struct of relation (NULL outside the domain), evidence_span (NULL when blank or not text),
    confidence (clipped to [0, 1], 0 when missing) and reason (`invalid_json` when unreadable, `non_object_json` when the
    whole answer is JSON of another kind, such as a list).
    """
    def fields(doc):
        relation = F.try_variant_get(doc, "$.relation", "string")
        quoted = F.schema_of_variant(F.try_variant_get(doc, "$.evidence_span", "variant")) == "STRING"
        span = F.when(quoted, F.try_variant_get(doc, "$.evidence_span", "string"))
        confidence = F.coalesce(F.try_variant_get(doc, "$.confidence", "double"), F.lit(0.0))
        ok = doc.isNotNull()
        return F.struct(
            F.when(ok & relation.isin(list(domain)), relation).alias("relation"),
            F.when(ok & (strip(span) != ""), span).alias("evidence_span"),
            F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(F.lit(0.0)).alias("confidence"),
            F.when(ok, F.coalesce(F.try_variant_get(doc, "$.reason", "string"), F.lit("")))
            .otherwise(F.lit("invalid_json")).alias("reason"))

    def answer(whole):
        other = whole.isNotNull() & ~F.schema_of_variant(whole).startswith("OBJECT")
        nothing = F.lit(None).cast("string")
        listed = F.struct(nothing.alias("relation"), nothing.alias("evidence_span"), F.lit(0.0).alias("confidence"), F.lit("non_object_json").alias("reason"))
        return F.when(other, listed).otherwise(let(F.try_parse_json(json_object_text(col)), fields))

    return let(F.try_parse_json(bare_answer(col)), answer)


def content_key(model, version, kind, text) -> Column:
    """Cache key of one call: digest of model, prompt version, kind and text."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (model, version, kind)]
    return F.sha2(F.concat_ws("|", *parts, _c(text)), 256)


def allen_relation(day, anchor) -> Column:
    day, anchor = _c(day), _c(anchor)
    return F.when(day < anchor, F.lit("BEFORE")).when(day > anchor, F.lit("AFTER")).otherwise(F.lit("OVERLAP"))


def printed_status(printed, value, digits, pct=False) -> Column:
    """OK when both numbers print alike (half up) with `digits` decimals; MISSING without a value.

    `digits` and `pct` may be columns: the scale is then applied per row.
    """
    printed, value = _c(printed), _c(value)
    digits = digits if isinstance(digits, Column) else F.lit(digits)
    pct = pct if isinstance(pct, Column) else F.lit(pct)
    shown = F.when(pct, value * 100).otherwise(value)
    scale = F.pow(F.lit(10.0), digits)

    def units(x):
        # Decimal arithmetic on the shortest text of the double, so .5 always rounds away from zero.
        return F.round(x.cast("string").cast("decimal(38,15)") * scale.cast("decimal(12,0)"), 0)

    return (
        F.when(value.isNull() | F.isnan(value), F.lit("MISSING"))
        .when(units(shown) == units(printed.cast("double")), F.lit("OK"))
        .otherwise(F.lit("MISMATCH"))
    )


def answered(abstained) -> Column:
    return ~_c(abstained)


def correct_answered(abstained, correct) -> Column:
    """Answered and correct; a missing `correct` counts as wrong."""
    return ~_c(abstained) & F.coalesce(to_double(correct) == 1, F.lit(False))


def unsafe_answer(abstained, correct) -> Column:
    return ~_c(abstained) & ~correct_answered(abstained, correct)
