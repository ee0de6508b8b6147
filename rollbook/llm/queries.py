"""Queries of the numbered operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .codes import books_digest, compress_vectors
from .lexical import ranked_search
from .licenses import TEMPLATES, Template, license_scan
from .near import near_duplicates
from .packing import pack
from .quality import classify, fit_classifier
from .repeats import removal_digests
from .rules import FULL, RULES, fails, quality_ledger
from .toxicity import fit_toxicity, toxicity
from .unigram import token_counts
from .urls import url_filter
from .vectors import near_vectors

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they stand for, as digests."""
    encoded = bpe_encode(documents(spark, sf_dir), BYTE_BPE)
    back = bpe_decode(encoded, BYTE_BPE, keep=("id", "n_tokens", "ids"))
    return back.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram tokens of every document."""
    return token_counts(documents(spark, sf_dir), PIECES).withColumnRenamed("id", "doc_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they stand in sequences of 1024 tokens."""
    return pack(documents(spark, sf_dir), BYTE_BPE, capacity=1024, end_id=2).withColumnRenamed("id", "doc_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without repeated strings of 200 bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return removal_digests(docs, length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


URL_ENTRIES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_ENTRIES).withColumnRenamed("id", "page_id")


def _rules_sql() -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_ENTRIES)
    return rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
entries(verdict, h, p) AS (VALUES {rows}),
fit AS (
  SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
  FROM parts JOIN entries ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit ON fit.rid = parts.rid AND k = 1"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = documents(spark, sf_dir)
    return classify(docs, fit_classifier(docs)).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document."""
    ledger = quality_ledger(documents(spark, sf_dir))
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return ledger.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~fails(FULL)).alias("kept"), F.col("failed").alias("failed_rules"))


_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
OP7_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS rows FROM docs),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM cut)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
measured AS (
  SELECT cut.rid, doc_id, len(words) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(rows) - len(list_distinct(rows)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(rows) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM cut LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))} AS failed_rules FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules
FROM judged"""


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9).withColumnRenamed("id", "vec_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of every document."""
    return license_scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _templates_sql() -> str:
    sets = [Template.of(label, text) for label, text in TEMPLATES]
    return ", ".join(f"({k}, '{t.label}', '{w}', {len(t.words)}, {t.need}, {t.span})" for k, t in enumerate(sets) for w in t.words)


_SIGNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
cut AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_SIGNS}') AS words FROM docs),
place AS (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM cut),
places AS (
  SELECT rid, i - 1 AS i, CASE WHEN words[i] = 'cc' AND words[i + 1] = 'by' THEN 'cc-by'
                               WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN 'gpl'
                               WHEN words[i] = 'all' AND words[i + 1] = 'rights' AND words[i + 2] = 'reserved' THEN 'reserved' END AS label FROM place),
base AS (SELECT rid, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places WHERE label IS NOT NULL GROUP BY rid),
templates(template, label, word, n, need, span) AS (VALUES {_templates_sql()}),
marks AS (SELECT rid, template, label, n, need, span, i, words[i] AS word FROM place JOIN templates ON words[i] = word),
blocks AS (
  SELECT rid, label, n, need, list(word) OVER (PARTITION BY rid, template ORDER BY i RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS ws FROM marks),
met AS (SELECT rid, label, len(list_distinct(ws)) / n AS share FROM blocks WHERE len(list_distinct(ws)) >= need),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM met GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM cut LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _codes_sql(n_entries: int = 256, rounds: int = 4) -> str:
    """Plain rounds over all pairs of part and entry; distances have less than 2**53 / 256 in these tables."""
    steps = ["b0 AS (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {n})".format(n=n_entries)]
    squared = "CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT)"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, p, min({squared} * {n_entries} + e) AS best FROM parts JOIN b{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(mean ORDER BY i) AS c FROM (
    SELECT p, best % {n_entries} AS e, i, floor(sum(x[i]) / count(*)) AS mean FROM a{k} JOIN parts USING (rid, p), range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
{", ".join(steps)},
coded AS (
  SELECT rid, string_agg(lower(lpad(to_hex(best % {n_entries}), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best // {n_entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir), k=10)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12_SQL = rf"""
WITH found AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS terms FROM documents),
asked AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS terms FROM benchmark),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM found WHERE len(terms) > 0),
q AS (SELECT qid, item_id, term, count(*) AS qf FROM (SELECT qid, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
held AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM found) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, n_docs),
scored AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN held USING (term) JOIN weighed USING (term), totals GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels of two thirds of the ids."""
    docs = documents(spark, sf_dir)
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id")))
    return toxicity(docs, model, least=0.7).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_ranked_search": op12_ranked_search,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {
    "op5_url_filter": _rules_sql(),
    "op7_quality_rules": OP7_SQL,
    "op9_license_scan": OP9_SQL,
    "op11_vector_codes": _codes_sql(),
    "op12_ranked_search": OP12_SQL,
}
