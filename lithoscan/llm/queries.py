"""Queries op1 to op10 with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, line_dedup, mixing, ngram_join, packing, quality, token_count, token_orc, url_filter
from ._base import shared_dir, table

#: Folder of public vocabularies, read-only on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

CAPACITY = 2048

#: Sources that make up each domain of the mix; all others are reference.
DOMAINS = {"crawl": [f"src{k}" for k in range(5)], "forum": [f"src{k}" for k in range(5, 13)]}
MIX = mixing.Mix(domains={"crawl": 4, "forum": 3, "reference": 3}, languages={"en": 5, "fr": 2, "de": 2, "es": 1}, sources={"src0": 4}, max_epochs=3)

#: Dated entries of the URL lists: key, category, action, at.
LISTS = [
    ("spam-farm.example.org", "spam", "add", "2024-01-15"), ("spam-farm.example.org", "spam", "remove", "2024-05-01"), ("spam-farm.example.org", "spam", "add", "2024-07-10"),
    ("cheap-pills.example.com", "pharma", "add", "2024-02-01"), ("cheap-pills.example.com/en", "spam", "add", "2024-03-01"), ("cheap-pills.example.com/en", "spam", "remove", "2024-09-01"),
    ("casino-win.example.org", "gambling", "add", "2023-06-01"), ("m.casino-win.example.com", "gambling", "add", "2024-04-01"), ("casino-win.example.com", "gambling", "add", "2024-08-01"),
    ("free-bets.example.com", "gambling", "add", "2023-01-01"), ("free-bets.example.com", "gambling", "remove", "2024-06-15"), ("free-bets.example.com", "ads", "add", "2024-06-01"),
    ("ads-track.example.org", "ads", "add", "2024-01-01"), ("ads-track.example.com", "ads", "add", "2024-01-01"), ("ads-track.example.com", "ads", "remove", "2024-12-01"),
    ("tionsh.example.com/en", "adult", "add", "2024-10-01"), ("www.ththon.example.org", "malware", "add", "2024-11-05"),
]


def domain() -> Column:
    out = F.lit("reference")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(out)
    return out


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), CAPACITY)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20; each is held against all rows."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, asking=F.col("vec_id") % 20 == 0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX, domain())
    return d.select("doc_id", F.col("domain_").alias("domain"), "lang", "source", F.col("epoch_").alias("epoch"), packing.word_count("text").alias("n_tokens"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_orc/{uuid.uuid4().hex}"  # of this run: rows are read from there when the result is
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, VOCABULARY)
    return token_orc.read_token_orc(spark, path)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time: the test tables have none, so the page id spreads them over 2024."""
    day = F.make_dt_interval(F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + day).alias("fetched_at"))


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, category, action, at): LISTS, and a report of every page's URL, which holds for 60 days from a date of its own."""
    key = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[A-Za-z]+://", ""), r"[?#].*$", "")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 11, F.lit(366)).cast("int"))
    entry = lambda action, n: F.struct(F.lit(action).alias("action"), F.date_add(day, n).cast("string").alias("at"))
    reports = table(spark, sf_dir, "pages").select(key.alias("key"), F.lit("reported").alias("category"), F.explode(F.array(entry("add", 0), entry("remove", 60))).alias("e"))
    fixed = spark.createDataFrame(LISTS, "key string, category string, action string, at string")
    return fixed.unionByName(reports.select("key", "category", "e.action", "e.at"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = url_filter.filter_urls(captures(spark, sf_dir), url_lists(spark, sf_dir))
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched_at", "listed_since")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_nearest_neighbours, op3_line_dedup, op4_source_mixing, op5_quality_rules,
    op6_language_id, op7_token_counts, op8_ngram_jaccard, op9_token_orc, op10_url_filter,
)}


def line_dedup_sql(docs: str = "documents") -> str:
    """doc_id and text of documents without the lines that stand earlier in the table."""
    return rf"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE kept), '') END AS text
FROM (SELECT *, l IS NULL OR regexp_full_match(l, '[\x00-\x20]*') OR row_number() OVER (PARTITION BY l ORDER BY doc_id, i) = 1 AS kept
      FROM (SELECT doc_id, text, i, string_split(text, chr(10))[i] AS l
            FROM (SELECT doc_id, text, unnest(range(1, greatest(coalesce(len(string_split(text, chr(10))), 1), 1) + 1)) AS i FROM {docs})))
GROUP BY doc_id, text"""


def _fill_sql(nodes: str, parent: str, name: str) -> str:
    return f"""
SELECT *, CASE WHEN k0 IS NULL OR k < k0 THEN cap ELSE CAST((left0 * weight) // w0 AS BIGINT) END AS given FROM (
 SELECT *, min(CASE WHEN free THEN k END) OVER p AS k0, arg_min(CASE WHEN free THEN budget - before END, CASE WHEN free THEN k END) OVER p AS left0,
        arg_min(CASE WHEN free THEN from_here END, CASE WHEN free THEN k END) OVER p AS w0 FROM (
  SELECT *, (budget - before) * weight <= cap * from_here AS free FROM (
   SELECT *, CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
          CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS from_here, row_number() OVER o AS k
   FROM {nodes} WINDOW o AS (PARTITION BY {parent} ORDER BY cap / CAST(weight AS DOUBLE), {name})))
 WINDOW p AS (PARTITION BY {parent}))"""


def _case(col: str, weights: dict[str, int], default: int) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END" if weights else str(default)


def mixing_sql(docs: str = "documents", extra: str = "") -> str:
    dom = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + " ELSE 'reference' END"
    m = MIX
    return rf"""
WITH d AS (SELECT *, {dom} AS domain, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS n FROM {docs}),
leaves AS (SELECT domain, coalesce(lang, '') AS language, coalesce(source, '') AS src, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {m.max_epochs} AS BIGINT) AS cap FROM d GROUP BY ALL HAVING sum(n) > 0),
top AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_case('domain', m.domains, m.default)} AS weight, (SELECT CAST(sum(tokens) * {m.budget_permille} // 1000 AS BIGINT) FROM leaves) AS budget, 0 AS root FROM leaves GROUP BY domain),
topg AS ({_fill_sql('top', 'root', 'domain')}),
mid AS (SELECT l.domain, l.language, CAST(sum(l.cap) AS BIGINT) AS cap, {_case('l.language', m.languages, m.default)} AS weight, any_value(g.given) AS budget FROM leaves l JOIN topg g USING (domain) GROUP BY l.domain, l.language),
midg AS ({_fill_sql('mid', 'domain', 'language')}),
low AS (SELECT l.*, {_case('l.src', m.sources, m.default)} AS weight, g.given AS budget FROM leaves l JOIN midg g USING (domain, language)),
plan AS (SELECT domain, language, src, given // tokens AS whole, given % tokens AS rest FROM ({_fill_sql('low', 'domain, language', 'src')})),
placed AS (SELECT d.*, whole, rest, md5('{m.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN plan p ON d.domain = p.domain AND coalesce(d.lang, '') = p.language AND coalesce(d.source, '') = p.src),
summed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY domain, lang, source, h) AS own FROM placed),
used AS (SELECT *, whole + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - own) THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, {extra or 'domain, lang, source, n AS n_tokens'}, CAST(unnest(range(0, times)) AS INTEGER) AS epoch FROM used WHERE times > 0"""


_VALUES = ", ".join(f"('{k}', '{c}', '{a}', TIMESTAMP '{t}')" for k, c, a, t in LISTS)

URL_SQL = rf"""
WITH raw AS (SELECT k, c, a, t FROM (VALUES {_VALUES}) v(k, c, a, t)
 UNION ALL SELECT regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', ''), 'reported', unnest(['add', 'remove']), TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST((page_id * 11) % 366 + unnest([0, 60]) AS INTEGER) FROM pages),
e AS (SELECT rtrim(regexp_replace(lower(k), '^www\.', ''), '/') AS key, c AS category, t AS day, max(a) AS action FROM raw GROUP BY ALL),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST((page_id * 7) % 366 AS INTEGER) AS t,
      regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
hit AS (SELECT page_id, key, category, max(day) AS since FROM p JOIN e ON day <= t AND (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1)))
        AND (NOT contains(key, '/') OR starts_with(rtrim(path, '/') || '/', substr(key, strpos(key, '/')) || '/'))
        GROUP BY page_id, key, category HAVING arg_max(action, day) = 'add'),
best AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, (list(struct_pack(n := -length(key), k := key, s := -epoch_us(since), d := since) ORDER BY -length(key), key, -epoch_us(since)))[1] AS m FROM hit GROUP BY page_id)
SELECT p.page_id, p.url, strftime(t, '%Y-%m-%d') AS fetched_at, m IS NOT NULL AS blocked, coalesce(categories, '') AS categories, m.k AS matched_key, strftime(m.d, '%Y-%m-%d') AS listed_since
FROM p LEFT JOIN best USING (page_id)"""

NGRAM_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {ngram_join.N} THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
      ELSE list_transform(range(1, len(w) - {ngram_join.N} + 2), lambda i: array_to_string(w[i:i + {ngram_join.N} - 1], ' ')) END) AS t FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE o >= {ngram_join.THRESHOLD} * (x.n + y.n - o)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a), k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, coalesce(links, 0) AS links FROM documents LEFT JOIN m ON m.a = doc_id LEFT JOIN k ON k.a = doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup_sql(), "op4_source_mixing": mixing_sql(), "op8_ngram_jaccard": NGRAM_SQL, "op10_url_filter": URL_SQL,
}
