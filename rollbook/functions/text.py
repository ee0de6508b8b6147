"""Text normalisation, cleaning, keys and case, all as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: they decide ids and search keys, so they are stated exactly. ---
QUOTE_CHARS = "«»“”„‟\"‘’‚‛'"
SPACE_CHARS = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
CYRILLIC_I = "і"
ID_LENGTH = 12
# ----------------------------------------------------------------------------------

SPACE_CLASS = f"[{SPACE_CHARS}]"
LINE_SPACE_CLASS = "[" + SPACE_CHARS.replace("\n", "") + "]"

# 'İ' grows when lowered and 'Σ' lowers by context; both go round through single characters.
KEPT = "\ue000"  # stands for a character that lowering must not touch
LOWER_GUARD = ("İΣ", KEPT + "σ")
FOLD_FROM = "ёi" + QUOTE_CHARS + SPACE_CHARS + KEPT
FOLD_TO = "е" + CYRILLIC_I + '"' * len(QUOTE_CHARS) + " " * len(SPACE_CHARS) + "İ"


def normalize(text: Column) -> Column:
    """Search form of a text; one character in, one character out, so offsets stay valid."""
    return F.translate(F.lower(F.translate(text, *LOWER_GUARD)), FOLD_FROM, FOLD_TO)


def normalize_compact(text: Column) -> Column:
    """Search form with runs of blanks folded and the ends trimmed."""
    return F.trim(F.regexp_replace(normalize(text), " {2,}", " "))


def clean(text: Column) -> Column:
    """Multi-line cell: no CR or NBSP, no blank tails, at most one empty line, trimmed lines."""
    flat = F.translate(text, "\u00a0\r", " ")
    t = F.regexp_replace(flat, "[ \\t]+\\n", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = F.regexp_replace(t, f"(?md)^{LINE_SPACE_CLASS}+|{LINE_SPACE_CLASS}+$", "")
    return strip(F.when(F.contains(flat, F.lit("\n")), t).otherwise(flat))


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only U+0020."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def one_line(text: Column) -> Column:
    """Single line, single blanks, no blank before a comma."""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")
    return F.trim(F.replace(folded, F.lit(" ,"), F.lit(",")))


def truncated(text: Column, limit: int) -> Column:
    """One line, cut to ``limit`` characters; NULL becomes empty."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")), 1, limit)


def blank_if_no_data(text: Column, marker: str = "(?iu)^д\\s*/\\s*о\\.?$") -> Column:
    """A cell that only says 'no data' becomes empty."""
    t = one_line(text)
    return F.when(t.rlike(marker), F.lit("")).otherwise(t)


def stable_id(kind: str | None, *parts: Column) -> Column:
    """First 12 hex digits of SHA-1 over the kind and the parts, joined by '|'."""
    lead = [] if kind is None else [F.lit(kind)]
    joined = F.concat_ws("|", *lead, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.substring(F.sha1(joined), 1, ID_LENGTH)


def title_case(text: Column) -> Column:
    """First letter of each run of letters upper, the rest lower."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+|[^\\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def cut_title(text: Column, limit: int = 220) -> Column:
    """One line without punctuation at the end, cut at a word and closed with an ellipsis."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, f"{SPACE_CLASS}+", " "), "[;,. ]+$", ""))
    short = F.regexp_replace(F.substring(t, 1, limit - 1), " +[^ ]*$", "")
    return F.when(F.length(t) > limit, F.concat(short, F.lit("…"))).otherwise(t)


def rounded(x: Column) -> Column:
    """Half always rounds up, also below zero."""
    return F.floor(x + F.lit(0.5))


def similar_names(a: Column, b: Column, share: float, prefix: bool = False, max_len: int | None = None) -> Column:
    """Equal, or within ``max(2, share of the longer)`` edits; optionally a long common prefix."""
    na, nb = normalize_compact(F.coalesce(a, F.lit(""))), normalize_compact(F.coalesce(b, F.lit("")))
    short, long = F.least(F.length(na), F.length(nb)), F.greatest(F.length(na), F.length(nb))
    allowed = F.greatest(F.lit(2), rounded(long * F.lit(share))).cast("int")
    near = F.call_function("levenshtein", na, nb, allowed) >= 0
    near = (long - short <= allowed) & near
    if max_len is not None:
        near = (long <= max_len) & near
    hit = (na == nb) | near
    if prefix:
        shared = F.when(F.length(na) <= F.length(nb), F.startswith(nb, na)).otherwise(F.startswith(na, nb))
        hit = (na == nb) | ((short >= 30) & (short >= long * 0.5) & shared) | near
    return (na != "") & (nb != "") & hit


def same_or_cut(a: Column, b: Column, at_least: int = 20) -> Column:
    """Equal normalised texts, or one is a prefix of the other and both are long enough."""
    na, nb = normalize_compact(F.coalesce(a, F.lit(""))), normalize_compact(F.coalesce(b, F.lit("")))
    shared = F.when(F.length(na) <= F.length(nb), F.startswith(nb, na)).otherwise(F.startswith(na, nb))
    return (na == nb) | ((F.least(F.length(na), F.length(nb)) >= at_least) & shared)


def extract_codes(text: Column, lead: str = "(?:стат[а-яё]*|ст\\.(?:\\s*ст\\.?)?)") -> Column:
    """Numbers like ``342`` or ``361-4`` listed after a lead word, in text order, without repeats."""
    code = "\\d{2,3}(?:-\\d)?"
    run = f"(?iu){lead}\\s*({code}(?:\\s*,\\s*(?:и\\s*)?{code})*)"
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")
    runs = F.regexp_extract_all(flat, F.lit(run), 1)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(code), 0))))


def codes_label(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, F.concat(F.lit("ст. "), F.array_join(codes, ", "), F.lit(" УК"))).otherwise(F.lit(""))
