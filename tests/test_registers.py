"""The register lists end to end on invented records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.functions import labels
from rollbook.operators import search
from rollbook.sources import ingest, publish, registers


def frame(spark, name, *records):
    schema = spark.createDataFrame([], registers.SCHEMAS[name]).schema
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in records], schema)


@pytest.fixture(scope="module")
def lists(spark):
    d = dt.date
    return {
        "m": frame(spark, "m", {"id": "m1", "type": "Книга", "name": "Синий том", "court": "Решение суда Северного района г.Эн от 5 мая 2020 года, статья 314 ГПК", "date": d(2020, 5, 5), "ord": 0}),
        "p": frame(spark, "p", {"id": "p1", "num": 7, "name": "Алый Бор", "translit": "Aly Bor", "birth": "01.02.1980", "basis": "приговор", "court": "суд Эн", "articles": ["342"], "address": "тайна", "citizenship": "X", "ord": 0},
                   {"id": "p2", "name": "Белый Лес", "birth": "03.03.1990", "articles": [], "ord": 1}),
        "w": frame(spark, "w", {"id": "w1", "name": "ИНОЙ", "aliases": ["Алый  бор"], "year": 1980, "region": "Эн", "agency": "МВД", "ord": 0}),
        "t": frame(spark, "t", {"id": "t1", "num": 1, "name": "алый бор", "birth": "01.03.1980", "basis": "Обвиняется по ст. 289", "articles": ["289"], "ord": 0},
                   {"id": "t2", "name": "Серый Дол", "birth": "09.09.1999", "articles": ["289"], "since": d(2021, 1, 1), "ord": 1}),
    }


def test_corpus(spark, lists):
    got = {r["id"]: r for r in registers.build_corpus(lists, folded_label="Folded B", mark="folded b").collect()}
    assert [r["id"] for r in sorted(got.values(), key=lambda r: r["pos"])] == ["m1", "p1", "p2", "w1", "t1", "t2"]
    assert got["t1"]["merged_into"] == "p1" and got["t1"]["list"] == "p" and got["t2"]["merged_into"] is None
    assert got["p1"]["marked"] and not got["p2"]["marked"] and got["t2"]["marked"]
    assert (got["p1"]["links_n"], got["w1"]["links_n"], got["t1"]["links_n"]) == (1, 1, 0)
    assert {k: got[k]["series"] for k in got} == {"m1": "gpk", "p1": "protest", "p2": "other", "w1": "wmvd", "t1": "terror", "t2": "terror"}
    assert got["m1"]["h"] == "синий том\nкнига\nсуда северного района г.эн\n5 мая 2020 05.05.2020"
    assert got["p1"]["h"].startswith("алый бор aly bor 01.02.1980\nст. 342 ук · folded b")
    assert "тайна" not in got["p1"]["h"] and got["w1"]["h"] == "иной алый бор 1980\nрозыск рф по запросу мвд\nэн\n"


def test_search_over_the_corpus(spark, lists):
    corpus = registers.build_corpus(lists, folded_label="Folded B", mark="folded b")
    qs = spark.createDataFrame([(1, "алый бор"), (2, "aly bor"), (3, "folded")], "q int, query string")
    got = {(r["q"], r["id"]) for r in search.staged_search(corpus, qs).collect()}
    assert got == {(1, "p1"), (1, "w1"), (2, "p1"), (2, "w1"), (3, "p1"), (3, "t2")}


def test_products_show_only_their_columns(spark, lists):
    rows = registers.details(lists)
    detail = {r["id"]: r["record"] for r in publish.public_projection(rows, registers.DETAIL_COLUMNS).collect()}
    assert "тайна" in detail["p1"] and "removed" not in detail["p1"] and "edited" not in detail["p1"]
    for allowed in (registers.FEED_COLUMNS, registers.DIGEST_COLUMNS):
        for r in publish.public_projection(rows, allowed).collect():
            assert "тайна" not in r["record"] and "1980" not in r["record"] and "citizenship" not in r["record"]


def test_labels(spark):
    r = spark.range(1).select(
        labels.court_name(F.lit("Решение суда Ленинского района г.Эн от 1 мая")).alias("court"), labels.court_name(F.lit("без\nничего")).alias("plain"),
        labels.person_court(F.lit("Вступивший в силу приговор Эн городского суда в связи с делом")).alias("person"),
        labels.article(F.lit("со статьей 302 Кодекса гражданского судопроизводства")).alias("article"), labels.article(F.lit("нет")).alias("none"),
        labels.case_status(F.lit("Обвиняется")).alias("status"),
    ).first()
    assert r["court"] == "суда Ленинского района г.Эн" and r["plain"] == "без" and r["person"] == "Эн городского суда"
    assert r["article"].asDict() == {"num": "302", "code": "kgs"} and r["none"] is None and r["status"] == "charged"


def test_text_table(spark):
    body = "Вид экстремистских материалов\tx\ty\t\nКнига\tИмя\tещё\tРешение от 5 мая 2020 года\t\n" + "д" * 90 + "\tхвост\t\n\t\t\t\nтолько\t\n"
    df = spark.createDataFrame([(1, body)], "k int, body string")
    got = [(r["type"], r["name"], r["court"], r["date"]) for r in ingest.text_records(df, "k", "body").orderBy("rec_no").collect()]
    assert got == [("Книга", "Имя\nещё", "Решение от 5 мая 2020 года", dt.date(2020, 5, 5)), ("", "д" * 90, "хвост", None)]


def test_absent_lists_are_empty(spark, lists):
    assert registers.build_corpus({"m": lists["m"]}).count() == 1


def test_public_meta_drops_addresses(spark):
    df = spark.createDataFrame([("p", "https://a/page", None, ["https://a/1.doc", "file:///x"])], "source string, source_page string, source_file string, source_files array<string>")
    r = registers.public_meta(df).first().asDict()
    assert r == {"source": "p", "files": ["https://a/1.doc"]}
