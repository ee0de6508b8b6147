"""Query parsing and spelling variants of a search token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CYRILLIC_I, normalize_compact

# --- Fixed values: letter tables of the spelling variants, in matching order. ---
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "і": CYRILLIC_I, "и": CYRILLIC_I,
    "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ў": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "yu", "я": "ya", "ґ": "g", "'": "", "ʼ": "",
}
CYRILLIC_TO_LACINKA = CYRILLIC_TO_LATIN | {
    "г": "h", "ж": "z", "й": "j", "х": "ch", "ц": "c", "ч": "c", "ш": "s", "щ": "sc", "ю": "ju", "я": "ja",
}
LATIN_TO_CYRILLIC = {
    "shch": "щ", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я", "yo": "е", "ye": "е",
    "a": "а", "b": "б", "c": "ц", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", CYRILLIC_I: CYRILLIC_I, "j": "й", "k": "к",
    "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в",
    "x": "кс", "y": "ы", "z": "з", "'": "ь",
}
LACINKA_TO_CYRILLIC = {
    "ch": "х", "dz": "дз", "dž": "дж", "ju": "ю", "ja": "я", "je": "е", "jo": "е", "ž": "ж", "č": "ч", "š": "ш",
    "ć": "ць", "ń": "нь", "ś": "сь", "ź": "зь", "ł": "л", "ŭ": "ў", "ó": "о",
    "a": "а", "b": "б", "c": "ц", "d": "д", "e": "э", "f": "ф", "g": "г", "h": "г", CYRILLIC_I: CYRILLIC_I, "j": "й", "k": "к",
    "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс",
    "y": "ы", "z": "з", "'": "ь",
}
HAS_LATIN = "[a-zžčšćńśźłŭó]"
HAS_CYRILLIC = "[а-яёўґ]"
ONE_WORD = "^[\\p{L}'ʼ-]+$"
MIN_LETTERS = 3
# --------------------------------------------------------------------------------


def _respell(token: Column, table: dict[str, str]) -> Column:
    """One left-to-right pass: the first spelling of the table that fits is replaced, other characters stay."""
    shape = "|".join(table) + "|."
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pieces = F.regexp_extract_all(token, F.lit(f"(?s){shape}"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(pairs, p), p)), "")


def _with_i_swaps(token: Column) -> Column:
    """The token, then its і/и swaps where they apply."""
    return F.array(
        token,
        F.when(F.contains(token, F.lit(CYRILLIC_I)), F.replace(token, F.lit(CYRILLIC_I), F.lit("и"))),
        F.when(F.contains(token, F.lit("и")), F.replace(token, F.lit("и"), F.lit(CYRILLIC_I))),
    )


def token_variants(token: Column) -> Column:
    """Distinct spellings of a normalised token, the token itself first."""
    plain_word = token.rlike(ONE_WORD) & (F.length(token) >= MIN_LETTERS)
    latin, cyrillic = token.rlike(HAS_LATIN), token.rlike(HAS_CYRILLIC)
    none = F.array().cast("array<string>")
    other = (
        F.when(plain_word & cyrillic & ~latin, F.array(_respell(token, CYRILLIC_TO_LATIN), _respell(token, CYRILLIC_TO_LACINKA)))
        .when(plain_word & latin & ~cyrillic, F.array(_respell(token, LATIN_TO_CYRILLIC), _respell(token, LACINKA_TO_CYRILLIC)))
        .otherwise(none)
    )
    long_enough = F.filter(other, lambda v: F.length(v) >= MIN_LETTERS)
    spelled = F.concat(_with_i_swaps(token), F.flatten(F.transform(long_enough, _with_i_swaps)))
    return F.array_distinct(F.filter(spelled, lambda v: v.isNotNull()))


def clean_token(token: Column) -> Column:
    """Link noise off: scheme, www., leading @, closing punctuation; never cleaned to nothing."""
    t = F.regexp_replace(token, "^https?://", "")
    t = F.regexp_replace(t, "^www\\.", "")
    t = F.regexp_replace(t, "^@", "")
    t = F.regexp_replace(t, "[/.,;:!?)]+$", "")
    return F.when(t == "", token).otherwise(t)


def query_tokens(query: Column) -> Column:
    """Tokens of a search string; a quoted phrase is one token."""
    pieces = F.regexp_extract_all(normalize_compact(F.coalesce(query, F.lit(""))), F.lit('"[^"]+"|[^ ]+'), 0)
    bare = F.transform(pieces, lambda p: F.trim(F.when(p.rlike('^"[^"]+"$'), F.regexp_replace(p, '^"|"$', "")).otherwise(p)))
    return F.filter(F.transform(bare, clean_token), lambda t: t != "")


def edit_budget(token: Column) -> Column:
    """Typos allowed: none below five letters, one up to seven, two from eight."""
    n = F.length(token)
    return F.when(n >= 8, 2).when(n >= 5, 1).otherwise(0)
