"""Word lists, lookup tables, patterns and texts that results depend on.

Everything in this module has to equal the published values for results to agree, so it is kept
as plain literals in one place. Operators take these as default arguments and accept others.
"""

# Relations between the two events of a note.
E1_BEFORE = "EVENT1-BEFORE-EVENT2"
E2_BEFORE = "EVENT2-BEFORE-EVENT1"
OVERLAP = "EVENT1-OVERLAP-EVENT2"
RELATIONS = [E1_BEFORE, E2_BEFORE, OVERLAP]
ABSTAINED = "ABSTAINED"

# Id suffixes of edited notes.
SUFFIXES = ["remove_evidence", "mask_temporal_cue", "silent_removal", "silent_keep"]

# Accepted spellings of "true", by producer.
TRUE_WORDS = ["1", "true", "yes", "y", "abstain", "abstained"]
TRUE_WORDS_FLOAT = ["1", "true", "yes", "1.0"]
TRUE_WORDS_YES = ["1", "true", "yes"]
TRUE_WORDS_NUMERIC = ["true", "1", "1.0"]
TRUE_WORDS_SHORT = ["true", "1"]

# Extraction confidence by note style: mean, default mean, spread, clip range.
STYLE_CONFIDENCE = {
    "verbose_discharge": 0.85,
    "structured_admission": 0.75,
    "nursing_note": 0.60,
    "terse_icu": 0.55,
}
DEFAULT_CONFIDENCE = 0.70
CONFIDENCE_SPREAD = 0.08
CONFIDENCE_RANGE = (0.05, 0.99)

# Temporal cues, in the order in which they are tried.
TEMPORAL_CUES = [
    "prior to", "before", "preceding", "following", "after",
    "subsequent to", "during", "concurrent with", "while undergoing",
]
MASK_TOKEN = "[MASKED_TEMPORAL_CUE]"
REDACTED = "[REDACTED]"
MASK_NOTICE = " The temporal cue needed to determine the relation was omitted."
REMOVED_SENTENCE = "The note does not document the temporal relationship between the two events."
REMOVED_NOTE = (
    "The patient was admitted for evaluation. The available documentation does not specify "
    "the temporal relationship between the two clinical events."
)
CONTRADICTION_CLAUSE = (
    " A separate record contradicts the stated ordering; the two events may have occurred in "
    "the opposite temporal order."
)
REMOVED_CONTRADICTION_CLAUSE = (
    " A separate record contradicts the proposed ordering, so the temporal relation cannot be "
    "determined reliably."
)
EVIDENCE_CASES = {
    "remove_evidence": "evidence_removed",
    "mask_temporal_cue": "temporal_cue_masked",
    "contradiction": "contradiction_injected",
    "remove_and_contradict": "evidence_removed_and_contradiction",
}

# White space of any kind, as a pattern.
WHITE = r"(?U:[\s\x1c-\x1f])"

# Wording families that betray an edit (case-insensitive).
MARKER_PATTERNS = {
    "omitted": r"\bomitt?ed\b",
    "not_stated": r"\bnot (?:specified|documented|stated|recorded|available|clear|reported|provided|known|determined)\b",
    "unspecified": r"\b(?:unspecified|undocumented|undated|unknown|unclear|unavailable)\b",
    "cannot_be": r"\b(?:cannot|can not|unable to|not possible to)\b",
    "redacted": r"\b(?:redact\w*|removed|missing|masked)\b",
    "no_info": r"\bno (?:information|details?|data|record)\b",
    "meta_temporal": r"\b(?:temporal|timing|chronolog\w*|relationship)\b",
    "brackets": r"\[[^\]]*\]",
    "ellipsis": r"\.\.\.|…",
    "filler": r"\*\*\*|xxx+|___+|\bTBD\b|\bn/?a\b",
}
# Literals, in lower case, of which every match of a family holds one.
MARKER_LITERALS = {
    "omitted": ["omit"],
    "not_stated": ["not specified", "not documented", "not stated", "not recorded", "not available", "not clear", "not reported",
                   "not provided", "not known", "not determined"],
    "unspecified": ["unspecified", "undocumented", "undated", "unknown", "unclear", "unavailable"],
    "cannot_be": ["cannot", "can not", "unable to", "not possible to"],
    "redacted": ["redact", "removed", "missing", "masked"],
    "no_info": ["no information", "no detail", "no data", "no record"],
    "meta_temporal": ["temporal", "timing", "chronolog", "relationship"],
    "brackets": ["["],
    "ellipsis": ["...", "…"],
    "filler": ["***", "xxx", "___", "tbd", "n/a"],
}
# What a match without any of its family's literals holds, in lower case: a literal and a pattern of it.
MARKER_SHAPES = {"filler": ("na", r"na(?![a-z0-9_])(?<![a-z0-9_]na)")}
# Letters beyond ASCII that a pattern without regard to case takes for s, i, i and k.
FOLDED_LETTERS = ["ſ", "ı", "İ", "\u212a"]

# Explicit temporal cue (case-insensitive).
EXPLICIT_CUE = (
    r"\b(?:day|hospital day|hd|pod|d)\s*#?\s*\d+\b"
    r"|\b(?:first|second|third|fourth|fifth|sixth|seventh|next|following|previous|prior)\s+(?:day|morning|evening|night)\b"
    r"|\b(?:today|yesterday|tomorrow|overnight|on admission|upon admission|at admission)\b"
    r"|\b(?:before|after|prior to|following|subsequent(?:ly)?|thereafter|afterwards?|then|while|during|"
    r"concurrent(?:ly)?|simultaneous(?:ly)?|at the same time|same day|later|earlier|initially|once|upon|"
    r"previously|preceded|followed|as a result|consequently|in response to|ensuing|meanwhile|"
    r"at that time|shortly)\b"
    r"|\b(?:pre|post)[- ]?(?:op(?:erative(?:ly)?)?|treatment|procedure|intervention)\b"
    r"|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
)
# The same with its leading word boundary tested once.
EXPLICIT_CUE_ONCE = r"\b(?:" + EXPLICIT_CUE.removeprefix(r"\b").replace(r"|\b", "|") + ")"
DAY_MENTION = r"\bday\s*(\d+)"
FABRICATED_CLAUSE = r"Notably,.*?not treated\."

# Literal rewrites per note style, applied in order.
LEXICAL_STYLES = {
    "terse_icu": {
        "the patient": "pt", "diagnosed with": "dx'd w/", "was initiated": "started",
        "intravenous": "IV", "day": "d", "with": "w/", "and": "&", "following": "s/p",
    },
    "nursing_note": {
        "the patient": "pt", "reported": "c/o", "was initiated": "given",
        "intravenous": "IV", "monitored": "obs'd",
    },
}
STRUCTURED_STYLE = "structured_admission"

# Contradictions that can be injected.
CONTRADICTION_TYPES = [
    "fabricated_symptom", "temporal_contradiction", "dosage_contradiction", "negation_flip",
]
SYMPTOMS = [
    "shortness of breath", "abdominal pain", "palpitations", "lower extremity edema",
    "productive cough", "fever and chills", "dizziness", "chest tightness", "nausea and vomiting", "fatigue",
    "diaphoresis", "confusion", "hematemesis", "syncope", "jaundice", "back pain",
    "decreased urine output", "headache", "tachycardia", "hypotension",
]
DOSES = ["1g IV q8h", "500mg PO BID", "2g IV q24h", "40mg PO once daily", "10 units subcutaneously"]
DAY_SHIFTS = [-3, -2, 2, 3]

# Word tables of the text perturbations.
ABBREVIATIONS = {
    "intravenous": "IV", "day": "d", "diagnosed": "dx'd", "patient": "pt",
    "treatment": "tx", "with": "w/", "and": "&",
}
OCR_CONFUSABLES = {"o": "0", "l": "1", "i": "1", "s": "5", "e": "3", "a": "@"}
SYNONYMS = {
    "initiated": "started", "reported": "noted", "diagnosed": "identified",
    "monitored": "observed", "remained": "stayed", "associated": "related",
}
FILLERS = ["also", "subsequently", "notably", "per report"]
PERTURBATIONS = ["abbreviation_swap", "ocr_noise", "token_insertion", "synonym_substitution"]

# Acceptance limits of edited notes.
REMOVAL_LENGTH_RATIO = (0.30, 1.25)
KEEP_LENGTH_RATIO = (0.70, 1.40)
MAX_NOVEL_REMOVAL = 0.25
MAX_NOVEL_KEEP = 0.35

# Two normal quantiles are in use: the exact one (clamped interval) and the rounded one.
Z_EXACT = 1.959963984540054
Z_ROUNDED = 1.96

# Which parts make up each training recipe.
RECIPES = {
    "A": ["clean", "marker"],
    "B": ["clean", "silent_removal", "silent_keep"],
    "C": ["clean", "marker", "silent_removal", "silent_keep"],
    "D": ["clean", "silent_removal"],
    "E": ["clean", "marker_token", "notice_intact", "silent_removal", "silent_keep"],
}
