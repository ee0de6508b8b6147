"""Links and posts out of raw web pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_first_date
from ..functions.text import SPACE_CLASS

# --- Fixed values ---
ANCHOR = "(?is)<a\\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
PART_NO = "(?iu)часть\\s*(\\d+)"
TITLE_RULE = "(?iu)перечень\\s+организаций\\s+и\\s+физических\\s+лиц,?\\s+причастных\\s+к\\s+террористической\\s+деятельности"
# --------------------


def _encoded(url: Column) -> Column:
    """Percent-encode what may not stand in a URL."""
    pieces = F.regexp_extract_all(url, F.lit("[\\x21\\x23-\\x3b\\x3d\\x3f-\\x7e]+|[^\\x21\\x23-\\x3b\\x3d\\x3f-\\x7e]+"), 0)
    coded = F.transform(pieces, lambda p: F.when(p.rlike("^[\\x21\\x23-\\x3b\\x3d\\x3f-\\x7e]"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))))
    return F.array_join(coded, "")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path."""
    steps = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    closed = F.when(path.rlike("/\\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, closed).otherwise(F.lit("")))


def absolute_url(href: Column, page: Column) -> Column:
    """A link as seen from its page: absolute, scheme-relative, root-relative, query, fragment or relative."""
    scheme, origin = F.regexp_extract(page, "^([a-z]+):", 1), F.regexp_extract(page, "^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_extract(page, "^[a-z]+://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, "^/(.*/)?", 1))
    base = F.when(path == "", F.lit("/")).otherwise(path)
    target, tail = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "([?#].*)$", 1)
    query = F.regexp_extract(page, "(\\?[^#]*)", 1)
    return _encoded(
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(target), tail))
        .when(href.startswith("?"), F.concat(origin, base, href))
        .when(href.startswith("#"), F.concat(origin, base, query, href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, target)), tail))
    )


def page_links(pages: DataFrame, key: str, html: str, url: str, href_rule: str) -> DataFrame:
    """Every link whose href passes the rule: absolute url, one-line label, place among the kept links."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 1), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    labels = F.regexp_extract_all(html, F.lit(ANCHOR), 2)
    links = F.filter(F.arrays_zip(hrefs.alias("href"), labels.alias("label")), lambda x: x["href"].rlike(href_rule))
    label = F.trim(F.regexp_replace(F.regexp_replace("x.label", "<[^>]+>", " "), f"{SPACE_CLASS}+", " "))
    rows = pages.select(key, F.col(url).alias("_page"), F.posexplode(links).alias("link_no", "x"))
    return rows.select(key, "link_no", absolute_url(F.col("x.href"), F.col("_page")).alias("url"), label.alias("label"))


def ranked_links(links: DataFrame, key: str, label_rule: str, part_rule: str = PART_NO) -> DataFrame:
    """Links whose label passes, one per url (first place, last label), by part number and then page order."""
    kept = links.filter(F.col("label").rlike(label_rule))
    once = kept.groupBy(key, "url").agg(F.min("link_no").alias("ord"), F.max_by("label", "link_no").alias("label"))
    part = F.regexp_extract("label", part_rule, 1).try_cast("long")
    return once.withColumn("part", part).withColumn("rank_key", F.struct(F.coalesce(part, F.lit(2**53 - 1)).alias("part"), F.col("ord")))


def preferred_link(links: DataFrame, key: str, label_rule: str) -> DataFrame:
    """Per page the first link with a preferred label, else the first link."""
    rank = F.struct((~F.col("label").rlike(label_rule)).alias("other"), F.col("link_no"))
    return links.groupBy(key).agg(F.min_by("url", rank).alias("url"), F.min_by("label", rank).alias("label"))


def candidate_links(links: DataFrame, key: str, size: int = 3) -> DataFrame:
    """At most ``size`` distinct urls per page, in page order."""
    firsts = links.groupBy(key, "url").agg(F.min("link_no").alias("ord"))
    best = firsts.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "url"))), 1, size).alias("best"))
    return best.select(key, F.posexplode("best").alias("rank", "b")).select(key, "rank", "b.url")


@dataclass(frozen=True)
class BlockRules:
    """Where a post begins in a page of posts and how its fields are found. Fixed values of the page format."""

    start: str = "(?=<div class=\"tgme_widget_message_wrap)"
    post_id: str = "\\bdata-post=\"[^\"/]+/(\\d+)\""
    text: str = "(?s)class=\"tgme_widget_message_text[^\"]*\"[^>]*>(.*?)</div>"
    file_name: str = "tgme_widget_message_document_title[^>]*>([^<]*)<"
    size: str = "tgme_widget_message_document_extra[^>]*>([^<]*)<"
    stamp: str = "<time\\b[^>]*\\bdatetime=\"([^\"]+)\""


def unescape(text: Column) -> Column:
    """The five named entities; ``&amp;`` last, so nothing is unescaped twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def page_blocks(pages: DataFrame, key: str, html: str, rules: BlockRules = BlockRules()) -> DataFrame:
    """Posts of a page of posts: id, text, file name, file size and time; blocks without an id drop out."""
    def plain(c: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n"), "<[^>]+>", "")
        return F.trim(F.regexp_replace(unescape(F.replace(t, F.lit("&nbsp;"), F.lit(" "))), f"{SPACE_CLASS}+", " "))

    blocks = pages.select(key, F.explode(F.split(html, rules.start)).alias("block"))
    part = lambda shape: F.regexp_extract("block", shape, 1)
    posts = blocks.withColumn("post_id", part(rules.post_id).try_cast("long")).filter("post_id > 0")
    return posts.select(
        key, "post_id", plain(part(rules.text)).alias("text"), plain(part(rules.file_name)).alias("file_name"),
        plain(part(rules.size)).alias("size"), part(rules.stamp).alias("stamp"),
    )


def post_date(text: str = "text", stamp: str = "stamp") -> Column:
    """The version date named in a post, else the day it was posted."""
    return F.coalesce(day_first_date(F.col(text)), F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd"))


def fresh_version(posts: DataFrame, state: DataFrame, by: str, file_rule: str = "(?i)\\.xlsx$", title_rule: str = TITLE_RULE) -> DataFrame:
    """Per source the newest post with the list file, and whether it is newer than the base and not announced yet.

    ``state`` has at most one row per source: ``source_date, announced``.
    """
    fit = posts.filter(F.col("file_name").rlike(file_rule) & F.col("text").rlike(title_rule)).withColumn("version", post_date())
    newest = fit.groupBy(by).agg(F.max_by(F.struct("post_id", "version", "file_name"), "post_id").alias("p")).select(by, "p.*")
    newer = F.coalesce(F.col("version") > F.coalesce("source_date", F.lit("0001-01-01").cast("date")), F.lit(False))
    return newest.join(state, by, "left").withColumn("is_fresh", newer & (F.col("post_id") > F.coalesce("announced", F.lit(0))))
