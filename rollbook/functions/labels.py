"""Decisions, labels and series of the register lists, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, codes_label

# --- Fixed values: words of the labels and codes; they are part of the search text and of the series. ---
COURT_NAME = "(?iu)(суд[а-я]*\\s[^\\n]*?)(?=\\s+от\\s+\\d|\\s*\\n|\\s+\\d{1,2}\\s+[а-я]+\\s+\\d{4}|$)"
DECISION_WORD = "(?:приговор[а-яё]*|постановлени[ея]|определени[ея])"
CODE_RULES = [
    ("gpk", "(?iu)гражданского процессуального кодекса|(?<![\\w])ГПК(?![\\w])"),
    ("kgs", "(?iu)кодекса гражданского судопроизводства|(?<![\\w])КГС(?![\\w])"),
]
KIND = {"formation": "Экстремистское формирование", "organization": "Экстремистская организация"}
DECIDER = {"mvd": "Решение МВД", "kgb": "Решение КГБ", "court": "Решение суда"}
AGENCY_SERIES = {"МВД": "wmvd", "КГК": "wkgk", "КГБ": "wkgb"}
SPEECH_CODES = ["130", "130-1", "367", "368", "369", "369-1", "370", "188", "203-1"]
PROTEST_CODES = ["342", "293"]
NEAR_COURT = f"(?iu){DECISION_WORD}\\s+(.{{1,300}}?)\\s*(?:в\\s+)?связи(?![а-яё])"
FAR_COURT = f"(?iu){DECISION_WORD}\\s+(.{{1,300}}?)\\s+(?:о|об|за|по)\\s"
ARTICLE = "(?iu)(\\d{2,3})(?:-?[йя])?\\s+стать[а-яё]*|стать[а-яё]*\\s+(\\d{2,3})"
CHARGED, SENTENCED = "(?iu)обвиня", "(?iu)приговор"
SERIES = {
    "m": ["gpk", "kgs", "none"], "f": ["mvd", "kgb", "court"], "p": ["protest", "speech", "ext", "terror", "other"],
    "w": ["wmvd", "wkgk", "wkgb", "wother"],
}
# --------------------------------------------------------------------------------------------------------


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " "))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def court_name(decision: Column) -> Column:
    """The court in the text of a decision, else its first line."""
    found = F.regexp_extract(decision, COURT_NAME, 1)
    return _line(F.when(found != "", found).otherwise(F.get(F.split(decision, "\n"), F.lit(0))))


def person_court(basis: Column) -> Column:
    """The court named after the decision word, up to 'in connection' or the next preposition."""
    line = _line(F.substring(basis, 1, 1500))
    near, far = F.regexp_extract(line, NEAR_COURT, 1), F.regexp_extract(line, FAR_COURT, 1)
    return F.trim(F.regexp_replace(F.when(near != "", near).otherwise(far), "[,;]+$", ""))


def article(decision: Column) -> Column:
    """Number and code of the article a decision refers to; NULL when none is named."""
    a, b = F.regexp_extract(decision, ARTICLE, 1), F.regexp_extract(decision, ARTICLE, 2)
    number = F.when(a != "", a).otherwise(b)
    code = F.lit(None).cast("string")
    for name, rule in reversed(CODE_RULES):
        code = F.when(decision.rlike(rule), F.lit(name)).otherwise(code)
    return F.when(number != "", F.struct(number.alias("num"), code.alias("code")))


def case_status(basis: Column) -> Column:
    """Charged, sentenced, or other."""
    b = F.coalesce(basis, F.lit(""))
    return F.when(b.rlike(CHARGED), "charged").when(b.rlike(SENTENCED), "verdict").otherwise("other")


def rule_series(rules: Sequence[tuple[str, Column]], other: str) -> Column:
    """The first rule that holds names the series."""
    out = F.lit(other)
    for name, test in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def code_series(codes: Column) -> Column:
    """Series of a person by the codes of the basis."""
    c = F.coalesce(codes, F.array().cast("array<string>"))
    among = lambda xs: F.arrays_overlap(c, F.array(*[F.lit(x) for x in xs]))
    rules = [("ext", F.exists(c, lambda x: x.rlike("^361(-\\d)?$"))), ("protest", among(PROTEST_CODES)), ("speech", among(SPEECH_CODES))]
    return rule_series(rules, "other")


def agency_series(agency: Column) -> Column:
    return F.coalesce(_lookup(AGENCY_SERIES, agency), F.lit("wother"))


def record_label(list_name: Column, cols: dict[str, Column], folded_label: str = "", mark: str = "") -> Column:
    """The searchable type line of a record of each list.

    What a record of the folded list is called, and what is added to a record that has one, is for the caller to say; nothing is
    by default.
    """
    codes = codes_label(cols["articles"])
    empty = F.lit("")
    joined = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" · "), b)).otherwise(F.concat(a, b))
    folded = joined(F.lit(folded_label), codes)
    agency = F.coalesce(cols["agency"], empty)
    wanted = F.when(agency != "", F.concat(F.lit("Розыск РФ по запросу "), agency)).otherwise(F.lit("Розыск РФ"))
    person = F.when(cols["marked"], joined(codes, F.lit(mark))).otherwise(codes)
    formation = F.coalesce(_lookup(KIND, cols["kind"]), F.lit(KIND["formation"]))
    return (
        F.when(list_name == "t", folded).when(list_name == "w", wanted).when(list_name == "p", person)
        .when(list_name == "f", formation).otherwise(F.coalesce(cols["type"], empty))
    )


def record_place(list_name: Column, cols: dict[str, Column]) -> Column:
    """The searchable court (or region, or deciding body) of a record."""
    empty = F.lit("")
    return (
        F.when(list_name == "t", empty).when(list_name == "w", F.coalesce(cols["region"], empty))
        .when(list_name == "p", F.coalesce(cols["court"], empty)).when(list_name == "f", F.coalesce(_lookup(DECIDER, cols["decided_by"]), empty))
        .otherwise(court_name(F.coalesce(cols["court"], empty)))
    )


def record_series(list_name: Column, cols: dict[str, Column]) -> Column:
    """The statistics series of a record."""
    return (
        F.when(list_name == "t", "terror").when(list_name == "w", agency_series(cols["agency"])).when(list_name == "p", code_series(cols["articles"]))
        .when(list_name == "f", F.coalesce(cols["decided_by"], F.lit("court")))
        .otherwise(F.coalesce(article(cols["court"])["code"], F.lit("none")))
    )
