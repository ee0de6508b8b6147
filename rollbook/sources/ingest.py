"""Loose text, cell maps and JSON into typed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import any_date, day_first_all, day_first_date, exact_or_before, serial_date, worded_date
from ..session import settle
from ..functions.text import blank_if_no_data, clean, extract_codes, normalize_compact, one_line, stable_id, truncated

# --- Fixed values: shapes and limits of the sources ---
TABLE_HEAD = "(?iu)вид экстремистских материалов"
LIST_HEAD = "(?iu)^республиканский список"
LONG_FIRST_CELL = 80
MAX_CELL = 5000
MAX_SHEET_CELL = 2000
DASHES = "^[-—–.\\s]*$"
NUMBER = "^\\d+$"
ANY_DATE = "\\d{1,2}\\.\\d{2}\\.\\d{2,4}"
MAX_NAME, MAX_ALIASES, MAX_SHORT, MAX_CATEGORY = 120, 10, 60, 80
YEAR_MIN, YEAR_MAX = 1900, 2100
FIRST_DECISION = "(\\d{1,2}\\.\\d{2}\\.\\d{4})\\s*(?:г\\.?\\s*)?№?\\s*([^\\s«»\"“”]+)?"
EXCLUDED_BASIS = "(?iu)санкционн|ООН|Совет[а-яё]* Безопасности"
ALSO_KNOWN = "(?iu)\\s*,?\\s*(?:на основании[^:]*?|может быть также|может быть)\\s*(?:известен|известна|известны)\\s+как:?\\s*"
CYRILLIC, LATIN = "(?iu)[а-яё]", "(?i)[a-z]"
DECIDERS = [
    ("kgb", "(?iu)КГБ|Комитет[а-я]* государственной безопасности"),
    ("mvd", "(?iu)МВД|Министерств[а-я]* внутренних дел"),
    ("court", "(?iu)(^|[^а-яё])суд"),
]
# ------------------------------------------------------


def _drop_blank_tail(cells: Column) -> Column:
    from_end = F.array_position(F.reverse(F.transform(cells, lambda c: c != "")), True)
    return F.when(from_end == 0, F.slice(cells, 1, 0)).otherwise(F.slice(cells, F.lit(1), F.size(cells) - from_end.cast("int") + 1))


def text_records(docs: DataFrame, key: str, body: str, record_sep: str = "\t\n", cell_sep: str = "\t", heads: tuple[str, str] = (TABLE_HEAD, LIST_HEAD)) -> DataFrame:
    """Three-column text tables to records ``type, name, court, date`` with a stable id.

    The last cell is the tail column, the cells between are the name; an over-long first cell without a tail
    is a name, not a type. Header rows and rows without a name drop out.
    """
    quoted = lambda sep: "\\Q" + sep + "\\E"
    raw = docs.select(key, F.posexplode(F.split(body, quoted(record_sep))).alias("rec_no", "raw"))
    rows = settle(raw, cells=F.transform(F.split("raw", quoted(cell_sep)), clean)).drop("raw")
    rows = settle(rows, cells=_drop_blank_tail(F.col("cells")))
    rows = rows.filter(F.size("cells") >= 2).filter(~F.get("cells", F.lit(0)).rlike(heads[0]))
    first, rest = F.get("cells", F.lit(0)), F.slice("cells", F.lit(2), F.size("cells") - 1)
    moved = (F.size("cells") == 2) & (F.length(first) > LONG_FIRST_CELL)
    rows = rows.select(
        key, "rec_no", F.when(moved, F.lit("")).otherwise(first).alias("type"), F.when(moved, F.col("cells")).otherwise(rest).alias("rest")
    )
    rows = rows.filter(~(F.col("type").rlike(heads[1]) & (F.size("rest") < 2)))
    n = F.size("rest")
    rows = rows.withColumns({
        "name": F.when(n >= 2, F.array_join(F.slice("rest", F.lit(1), n - 1), "\n")).otherwise(F.get("rest", F.lit(0))),
        "court": F.when(n >= 2, F.get("rest", n - 1)).otherwise(F.lit("")),
    }).filter(F.col("name") != "")
    ident = stable_id(None, *[normalize_compact(F.col(c)) for c in ("type", "name", "court")])
    return rows.select(key, "rec_no", ident.alias("id"), "type", "name", "court", worded_date(F.col("court")).alias("date"))


def first_decision(basis: Column) -> Column:
    """Date and number of the first decision named in a basis; a lasting key, later ones are appended."""
    day, number = F.regexp_extract(basis, FIRST_DECISION, 1), F.regexp_extract(basis, FIRST_DECISION, 2)
    return F.trim(F.concat_ws(" ", day, number))


def decided_by(basis: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shape in reversed(DECIDERS):
        out = F.when(basis.rlike(shape), F.lit(name)).otherwise(out)
    return out


def cellmap_records(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Sheet rows with ``cells MAP<STRING,STRING>`` (A…J) to records; only numbered rows with a name."""
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit(""))
    numbered = rows.filter(F.trim(cell("A")).rlike("^\\d+\\.?$"))
    named = numbered.select(*keep, "cells", one_line(cell("B")).alias("name"), clean(cell("F")).alias("basis")).filter(F.col("name") != "")
    kind = F.when(F.get(F.split("name", "[«\"]"), F.lit(0)).rlike("(?iu)организац"), "organization").otherwise("formation")
    return named.select(
        *keep,
        stable_id("formation", normalize_compact(F.col("name")), first_decision(F.col("basis"))).alias("id"),
        kind.alias("kind"), "name", clean(cell("C")).alias("alias"), clean(cell("D")).alias("links"),
        clean(cell("E")).alias("address"), "basis", decided_by(F.col("basis")).alias("decided_by"),
        F.coalesce(any_date(cell("G")), any_date(F.col("basis"))).alias("date"), any_date(cell("H")).alias("included"),
        clean(cell("I")).alias("info"), clean(cell("J")).alias("logo"),
    )


def rule_filtered_rows(rows: DataFrame, keep: list[str], excluded: str = EXCLUDED_BASIS) -> DataFrame:
    """Numbered sheet rows with the outcome of each: kept, excluded by its basis, or skipped (no name or basis)."""
    cell = lambda c: one_line(F.substring(F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")), 1, MAX_SHEET_CELL))
    numbered = rows.select(*keep, "cells", cell("A").alias("num"), cell("B").alias("name"), cell("G").alias("basis"))
    numbered = numbered.filter(F.col("num").rlike(NUMBER))
    outcome = F.when((F.col("name") == "") | (F.col("basis") == ""), "skipped").when(F.col("basis").rlike(excluded), "excluded").otherwise("kept")
    serial = F.date_format(serial_date(cell("E"), 1), "dd.MM.yyyy")
    birth = F.coalesce(serial, F.date_format(day_first_date(cell("E")), "dd.MM.yyyy"), blank_if_no_data(cell("E")))
    latin = cell("C")
    parts = F.split(latin, ALSO_KNOWN, 2)
    return numbered.select(
        *keep, outcome.alias("outcome"), stable_id("terror", normalize_compact(F.col("name")), birth).alias("id"),
        F.col("num").cast("long").alias("num"), "name", blank_if_no_data(F.trim(F.get(parts, F.lit(0)))).alias("translit"),
        F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("aka"), blank_if_no_data(cell("D")).alias("citizenship"),
        birth.alias("birth"), blank_if_no_data(cell("F")).alias("address"), "basis",
        extract_codes(F.col("basis")).alias("articles"), blank_if_no_data(cell("H")).alias("info"),
    )


def rule_filtered_ingest(rows: DataFrame, keep: list[str], excluded: str = EXCLUDED_BASIS) -> tuple[DataFrame, DataFrame]:
    """Kept records and one row of counters."""
    seen = rule_filtered_rows(rows, keep, excluded)
    kept = F.col("outcome") == "kept"
    counts = seen.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "excluded").alias("excluded"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(kept & ~F.col("birth").rlike("^\\d{2}\\.\\d{2}\\.\\d{4}$")).alias("no_birth"),
    )
    return seen.filter(kept).drop("outcome"), counts


def validated_rows(raw: DataFrame, keep: list[str], json: str = "raw", name_rule: str = CYRILLIC) -> DataFrame:
    """JSON entries to typed records, every field checked and cut; ``valid`` tells rejects apart."""
    raw = settle(raw, _entry=F.try_parse_json(json))
    entry = F.col("_entry")
    type_of = lambda c: F.schema_of_variant(F.try_variant_get(entry, f"$.{c}", "variant"))
    as_text = lambda c: F.try_variant_get(entry, f"$.{c}", "string")
    text = lambda c, n: truncated(F.when(type_of(c) == "STRING", as_text(c)), n)
    name, year = text("n", MAX_NAME), as_text("d").try_cast("double")
    whole_year = F.coalesce((year == F.floor(year)) & year.between(YEAR_MIN, YEAR_MAX), F.lit(False))
    listed = F.try_variant_get(entry, "$.a", "array<variant>")
    names = F.transform(listed, lambda a: truncated(F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")), MAX_NAME))
    aliases = F.slice(F.filter(names, lambda a: a != ""), 1, MAX_ALIASES)
    when, first = exact_or_before(as_text("w")), exact_or_before(as_text("w0"))
    first_text = F.coalesce(F.date_format(first["exact"], "yyyy-MM-dd"), F.when(first["before"] != "", F.concat(F.lit("<"), first["before"])), F.lit(""))
    state = F.when(type_of("s") == "BIGINT", F.try_variant_get(entry, "$.s", "int"))
    mark = text("rf", MAX_SHORT)
    return raw.select(
        *keep, (entry.isNotNull() & (name != "") & name.rlike(name_rule) & whole_year).alias("valid"),
        stable_id("wanted", normalize_compact(name), year.cast("int").cast("string")).alias("id"), name.alias("name"),
        F.when(F.size(aliases) > 0, aliases).alias("aliases"), F.when(whole_year, year.cast("int")).alias("year"),
        text("v", MAX_SHORT).alias("nationality"), text("r", MAX_SHORT).alias("region"), text("dp", MAX_SHORT).alias("agency"),
        when["exact"].alias("date"), when["before"].alias("before"), first_text.alias("first"), text("c", MAX_CATEGORY).alias("category"),
        F.when(mark.isin("terr", "extr"), mark).otherwise(F.lit("")).alias("rf"),
        F.coalesce(state == 2, F.lit(False)).alias("out"), F.coalesce(state == 1, F.lit(False)).alias("fresh"),
    )


def validated_ingest(raw: DataFrame, keep: list[str], json: str = "raw", name_rule: str = CYRILLIC) -> tuple[DataFrame, DataFrame]:
    """Valid records and one row of counters."""
    rows = validated_rows(raw, keep, json, name_rule)
    ok = F.coalesce(F.col("valid"), F.lit(False))
    counts = rows.agg(
        F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"), F.count_if(ok & F.col("date").isNull()).alias("approx"),
        F.count_if(ok & F.col("out")).alias("out"), F.count_if(ok & F.col("fresh")).alias("fresh"),
    )
    return rows.filter(ok).drop("valid"), counts


@dataclass(frozen=True)
class AnchorRules:
    """What makes a cell the anchor of a record, and what is no name. Fixed values of the source format."""

    word: str = "(?iu)(^|[^а-яё])(приговор[а-яё]*|постановлени[ея]|определени[ея])(?![а-яё])"
    context: str = "(?iu)суд|стат"
    min_len: int = 40
    not_name: str = (
        "(?iu)республик|федерац|гражданств|^рф$|^(отбывает|судимость|находится|освобожд[а-яё]*|принудительн[а-яё]*"
        "|признан[а-яё]*|отсрочка|применен[а-яё]*|умер[а-яё]*)(?![а-яё])|област|район|(^|\\s)(г|д|аг|гп|п|ул)\\.\\s"
    )
    name_shape: str = "^[А-ЯЁа-яёA-Za-z][А-ЯЁа-яёA-Za-z'’ʼ()\\-\\s]+$"
    max_name: int = 80
    max_birth: int = 14


def anchor_segments(docs: DataFrame, key: str, body: str, rules: AnchorRules = AnchorRules()) -> DataFrame:
    """Records of a tab-separated table whose rows are ragged, found by their anchor cell.

    An anchor (a long enough cell that names a decision) needs a date beside it: a birth date before it or an
    entry date after it. The cells since the previous record are its head: number, name, transliteration,
    citizenship. Leftovers are counted and never given to a neighbour. Works on arrays inside one document.
    """
    blank = F.translate(F.col(body), "\u00a0\r", " ")
    cells = F.transform(F.split(blank, "\t"), lambda c: F.trim(F.substring(c, 1, MAX_CELL)))
    at = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    is_anchor = lambda c: (F.length(c) >= rules.min_len) & c.rlike(rules.word) & c.rlike(rules.context)

    def anchor(i):
        born = at(i - 1).rlike(ANY_DATE) & (F.length(at(i - 1)) <= rules.max_birth)
        entered = at(i + 1).rlike(ANY_DATE)
        end = F.when(entered, i + 3).when(born, i + 2 + (F.get("cells", i + 1) == "").cast("int")).otherwise(i)
        end = F.coalesce(end, i + 2)
        return F.struct(i.alias("i"), born.alias("born"), entered.alias("entered"), end.alias("end"))

    def cut(a, before):
        low = F.greatest(F.least(before + 1, a["i"] - 1), F.lit(0))
        own = F.slice("cells", low + 1, F.greatest(a["i"] + 4, a["end"] + 2) - low + 1)
        return F.struct(
            own.alias("cells"), (a["i"] - low).alias("i"), a["born"].alias("born"), a["entered"].alias("entered"), (a["end"] - low).alias("end"), (before - low).alias("prev"))

    docs = settle(docs.select(key, body), cells=cells).drop(body).filter(F.size("cells") >= 2)
    places = F.filter(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: is_anchor(at(i)))
    docs = settle(docs, anchors=F.transform(places, anchor))
    # an end reaches at most three cells past its anchor, so the last four anchors decide where a head begins
    prev = F.transform("anchors", lambda a, t: F.coalesce(
        F.array_max(F.transform(F.slice("anchors", F.greatest(t - 3, F.lit(1)), F.least(t, F.lit(4))), lambda b: b["end"])), F.lit(-1)))
    # each segment takes its own cells along, from the end of the one before to the last cell that its end can name
    zipped = F.transform(F.arrays_zip("anchors", prev.alias("prev")), lambda z: cut(z["anchors"], z["prev"]))
    rows = docs.select(key, F.posexplode(zipped).alias("seg", "z")).select(key, "seg", "z.*")

    stop = F.when(F.col("born"), F.col("i") - 2).otherwise(F.col("i") - 1)
    spots = F.when(stop > F.col("prev"), F.sequence(F.col("prev") + 1, stop)).otherwise(F.array().cast("array<int>"))
    full = lambda k: (at(k) != "") & ~at(k).rlike(DASHES)
    void_number = lambda k: at(k).rlike(NUMBER) & at(k + 1).rlike(DASHES)
    rows = settle(rows, spots=F.filter(spots, full))
    head = F.transform(F.filter("spots", lambda k: ~void_number(k)), at)
    rows = settle(rows, excluded=F.size(F.filter("spots", void_number)), head=head)
    numbers = F.filter(F.transform("head", lambda c, k: F.when(c.rlike(NUMBER), k)), lambda k: k.isNotNull())
    rows = settle(rows, num_at=F.coalesce(F.array_max(numbers), F.lit(-1)))
    after = F.slice("head", F.col("num_at") + 2, F.size("head"))
    rows = settle(rows, after=after)
    rows = settle(rows, rest=F.when(F.size("after") > 3, F.slice("after", -3, 3)).otherwise(F.col("after")))
    letters = lambda c, shape: F.regexp_count(c, F.lit(shape))
    latin = lambda c: letters(c, LATIN) > letters(c, CYRILLIC)
    rows = settle(rows, lat=F.filter("rest", latin), cyr=F.filter("rest", lambda c: c.rlike(CYRILLIC) & ~latin(c)))
    like_name = lambda c: (F.length(c) <= rules.max_name) & c.rlike(rules.name_shape) & c.rlike("\\S\\s+\\S") & ~c.rlike(rules.not_name)
    last_like = F.array_max(F.filter(F.transform("cyr", lambda c, k: F.when(like_name(c), k)), lambda k: k.isNotNull()))
    first_other = F.array_min(F.filter(F.transform("cyr", lambda c, k: F.when(~c.rlike(rules.not_name), k)), lambda k: k.isNotNull()))
    rows = settle(rows, name_at=F.coalesce(last_like, first_other, F.lit(-1)))

    dated = F.col("born") | F.col("entered")
    outcome = F.when(~dated, "unanchored").when(F.col("name_at") < 0, "skipped").otherwise("record")
    dropped = F.greatest(F.col("num_at"), F.lit(0)) + F.size("after") - F.size("rest") + F.greatest(F.col("name_at"), F.lit(0))
    name, entry = one_line(F.get("cyr", F.col("name_at"))), F.when(F.col("entered"), at(F.col("i") + 1)).otherwise(F.lit(""))
    birth = one_line(F.when(F.col("born"), at(F.col("i") - 1)).otherwise(F.lit("")))
    dates = day_first_all(entry)
    tail = F.when(F.col("entered"), F.col("i") + 2).otherwise(F.col("end") - 1)
    basis = one_line(at(F.col("i")))
    return rows.withColumn("outcome", outcome).select(
        key, "seg", "outcome", F.when(dated, dropped).otherwise(0).alias("dropped"), F.when(dated, F.col("excluded")).otherwise(0).alias("excluded"),
        stable_id("person", normalize_compact(name), birth, F.coalesce(F.get(dates, F.lit(0)), F.lit(""))).alias("id"),
        F.when(F.col("num_at") >= 0, F.get("head", F.col("num_at")).try_cast("long")).alias("num"), name.alias("name"),
        one_line(F.array_join("lat", " ")).alias("translit"),
        one_line(F.array_join(F.slice("cyr", F.col("name_at") + 2, 3), " ")).alias("citizenship"), birth.alias("birth"),
        basis.alias("basis"), extract_codes(basis).alias("articles"),
        F.when(F.size(dates) > 0, F.array_join(dates, ", ")).otherwise(one_line(entry)).alias("included"),
        day_first_date(entry).alias("date"), one_line(at(tail)).alias("address"), one_line(at(tail + 1)).alias("info"),
    )


def segment_metrics(segments: DataFrame, key: str) -> DataFrame:
    """Counters per document. Cells dropped before its first record are its table header and do not count."""
    first = F.min(F.when(F.col("outcome") == "record", F.col("seg"))).over(Window.partitionBy(key))  # the segments of one document
    rows = segments.withColumn("first_record", first)
    late = F.col("seg") > F.col("first_record")
    return rows.groupBy(key).agg(
        F.count_if(F.col("outcome") == "record").alias("records"), F.sum("excluded").alias("excluded"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "unanchored").alias("unanchored"),
        F.coalesce(F.sum(F.when(late, F.col("dropped"))), F.lit(0)).alias("leftover"),
        F.count_if((F.col("outcome") == "record") & (F.col("included") == "")).alias("no_included"),
    )


def inbox_files(messages: DataFrame, chat: str, file_rule: str = "(?i)\\.xlsx$", max_bytes: int = 5_000_000) -> DataFrame:
    """Documents sent to one chat: file name and size rule, list date from the caption, link to the origin.

    ``messages`` has ``update_id`` and the message as JSON in ``message``.
    """
    schema = (
        "chat struct<id: string>, document struct<file_id: string, file_name: string, file_size: bigint>, caption string, text string,"
        " forward_origin struct<type: string, chat: struct<username: string>, message_id: bigint>"
    )
    m = F.from_json("message", schema)
    rows = messages.select("update_id", m.alias("m")).filter(
        (F.col("m.chat.id") == chat) & F.col("m.document.file_name").rlike(file_rule) & (F.coalesce("m.document.file_size", F.lit(0)) <= max_bytes)
    )
    caption = F.coalesce(F.nullif(F.col("m.caption"), F.lit("")), F.col("m.text"), F.lit(""))
    listed = F.coalesce(day_first_date(caption), F.when(caption.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(caption, "yyyy-MM-dd")))
    forwarded = (F.col("m.forward_origin.type") == "channel") & F.col("m.forward_origin.chat.username").isNotNull()
    link = F.concat(F.lit("https://t.me/"), F.col("m.forward_origin.chat.username"), F.lit("/"), F.col("m.forward_origin.message_id").cast("string"))
    return rows.select(
        "update_id", F.col("m.document.file_id").alias("file_id"), F.col("m.document.file_name").alias("file_name"), listed.alias("list_date"),
        F.when(forwarded, link).otherwise(F.concat(F.lit("telegram-bot:"), F.col("m.document.file_name"))).alias("source_url"),
    )
