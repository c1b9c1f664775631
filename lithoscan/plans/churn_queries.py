"""Queries over the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import churn
from .adapters import changes, commits

_LOG = """
log AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS commit_idx, n_name AS author, o_orderkey
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def _chg(path: str = "lower(p_type) || '/' || p_brand || '/' || p_name") -> str:
    return f"""WITH {_LOG},
chg AS (SELECT commit_idx, author, min(l_linenumber) AS pos, {path} AS path, CAST(sum(l_quantity) AS BIGINT) AS changes
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN log ON l_orderkey = o_orderkey GROUP BY commit_idx, author, {path}),
fc AS (SELECT path, count(*) AS commits, CAST(sum(changes) AS BIGINT) AS lines, min(commit_idx) AS first_seen, arg_min(pos, commit_idx * 1000 + pos) AS first_pos FROM chg GROUP BY path)"""


_SIZE = """
n AS (SELECT count(*) AS n FROM log),
s0 AS (SELECT n, greatest(1, CAST(round_even(n / 50.0, 0) AS BIGINT)) AS s FROM n),
span AS (SELECT n AS n_commits, CAST(CASE WHEN n <= 60 THEN 1 WHEN ceil(n / s) > 60 THEN greatest(1, ceil(n / 60.0)) WHEN ceil(n / s) < 30 THEN greatest(1, floor(n / 30.0)) ELSE s END AS BIGINT) AS bucket_size FROM s0),
spans AS (SELECT *, CAST(ceil(n_commits / bucket_size) AS BIGINT) AS num_buckets FROM span)"""


def _shades(cells: str, key: str) -> str:
    """History strings from (key, bucket, v) cells of the keys shown."""
    return f"""
peak AS (SELECT greatest(max(v), 1) AS p FROM {cells}),
hist AS (SELECT {key}, string_agg(CASE WHEN coalesce(v, 0) = 0 THEN ' ' ELSE substr('{churn.SHADES}', CAST(least(5, floor(v / p * 3) + 2) AS BIGINT), 1) END, '' ORDER BY b) AS h
 FROM (SELECT k.{key}, g.b, c.v FROM (SELECT DISTINCT {key} FROM {cells}) k CROSS JOIN (SELECT unnest(range(0, num_buckets)) AS b FROM spans) g LEFT JOIN {cells} c ON c.{key} = k.{key} AND c.bucket = g.b) CROSS JOIN peak GROUP BY {key})"""


def churn_top_files(spark: SparkSession, d: str) -> DataFrame:
    return churn.top_files(churn.file_churn(changes(spark, d))).select("rank", "path", "commits", "lines", "first_seen")


def churn_sort_commits(spark: SparkSession, d: str) -> DataFrame:
    return churn.top_files(churn.file_churn(changes(spark, d)), "commits").select("rank", "path", "commits", "lines")


def churn_sort_init(spark: SparkSession, d: str) -> DataFrame:
    return churn.top_files(churn.file_churn(changes(spark, d)), "init").select("rank", "path", "commits", "lines", "first_seen")


def churn_filters(spark: SparkSession, d: str) -> DataFrame:
    log, chg = churn.by_authors(commits(spark, d), changes(spark, d), ("_1", "N_2"))
    kept = chg.filter(churn.glob_filter(F.col("path"), ("economy/*", "*copper*"), ("*Brand#1*",)))
    return churn.top_files(churn.file_churn(kept), min_lines=40).select("rank", "path", "commits", "lines", "first_seen")


def churn_auto_bucket(spark: SparkSession, d: str) -> DataFrame:
    return churn.buckets(commits(spark, d))


def churn_heatmap(spark: SparkSession, d: str) -> DataFrame:
    log = commits(spark, d)
    return churn.heatmap(log, changes(spark, d, log=log))


def churn_author_activity(spark: SparkSession, d: str) -> DataFrame:
    log = commits(spark, d)
    return churn.author_activity(log, changes(spark, d, log=log).filter(churn.glob_filter(F.col("path"), ("economy/*",))))


def churn_sustained(spark: SparkSession, d: str) -> DataFrame:
    log = commits(spark, d)
    s = churn.sustained(log, changes(spark, d, log=log))
    return s.select("path", "active", "possible", F.round("continuity", 6).alias("continuity"), "commits", "lines")


def churn_summary(spark: SparkSession, d: str) -> DataFrame:
    return churn.churn_summary(changes(spark, d))


def churn_summary_json(spark: SparkSession, d: str) -> DataFrame:
    return churn.read_summary_json(churn.summary_json(changes(spark, d)))


def churn_log_parse(spark: SparkSession, d: str) -> DataFrame:
    """The log written as numstat text, newest first, and parsed again."""
    log = commits(spark, d)
    chg = changes(spark, d, log=log)
    head = log.select((-F.col("commit_idx")).alias("k"), F.lit(-1).alias("pos"), F.concat(F.lit("COMMIT\t"), "author").alias("text"))
    rows = chg.select((-F.col("commit_idx")).alias("k"), "pos", F.concat(F.col("changes").cast("string"), F.lit("\t0\t"), "path").alias("text"))
    from ..operators.ordering import dense_ordinal

    text = dense_ordinal(head.unionByName(rows), F.col("k"), [F.col("pos")], "line_no")
    parsed_log, parsed = churn.parse_numstat(text)
    return parsed.select("commit_idx", "author", "path", "changes")


def continuity_40(spark: SparkSession, d: str) -> DataFrame:
    log = commits(spark, d)
    return churn.presence_continuity(log, changes(spark, d, log=log)).select("path", F.round("continuity", 6).alias("continuity"))


def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return churn.cochange_pairs(changes(spark, d, "type")).withColumn("coupling", F.round("coupling", 6))


def cochange_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = churn.cochange_clusters(churn.cochange_pairs(changes(spark, d, "type"), 0.33))
    return c.withColumn("avg_coupling", F.round("avg_coupling", 6))


def cochange_cluster_report(spark: SparkSession, d: str) -> DataFrame:
    c = churn.clusters_within(churn.cochange_clusters(churn.cochange_pairs(changes(spark, d, "type"))))
    return c.withColumn("avg_coupling", F.round("avg_coupling", 6))


QUERIES = {f.__name__: f for f in (
    churn_top_files, churn_sort_commits, churn_sort_init, churn_filters, churn_auto_bucket, churn_heatmap, churn_author_activity, churn_sustained,
    churn_summary, churn_summary_json, churn_log_parse, continuity_40, cochange_pairs, cochange_clusters, cochange_cluster_report,
)}

_PAIRS = """{chg}, sz AS (SELECT commit_idx FROM chg GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), b AS (SELECT commit_idx, path FROM chg WHERE commit_idx IN (SELECT * FROM sz)),
co AS (SELECT x.path AS a, y.path AS b, count(*) AS co_commits FROM b x JOIN b y ON x.commit_idx = y.commit_idx AND x.path < y.path GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT co.*, co_commits / (fa.commits + fb.commits - co_commits) AS coupling FROM co JOIN fc fa ON fa.path = co.a JOIN fc fb ON fb.path = co.b
          WHERE co_commits / (fa.commits + fb.commits - co_commits) >= {t})"""
_CLUSTERS = _PAIRS + """, und AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
comp AS (SELECT x AS path, min(y) AS root FROM (WITH RECURSIVE r(x, y) AS (SELECT a, a FROM und UNION SELECT r.x, und.b FROM r JOIN und ON r.y = und.a) SELECT * FROM r) GROUP BY x),
cl AS (SELECT root, avg(coupling) AS avg_coupling, count(*) AS n_edges FROM pairs JOIN comp ON comp.path = pairs.a GROUP BY root),
cs AS (SELECT root, count(*) AS size FROM comp GROUP BY root)"""

_TOP = _chg() + ", best AS (SELECT *, row_number() OVER (ORDER BY {o}) AS rank FROM fc QUALIFY rank <= 20)"
_BY_LINES, _BY_COMMITS = "lines DESC, first_seen, first_pos, path", "commits DESC, lines DESC, first_seen, first_pos, path"

ORACLE_SQL = {
    "churn_top_files": _TOP.format(o=_BY_LINES) + " SELECT rank, path, commits, lines, first_seen FROM best",
    "churn_sort_commits": _TOP.format(o=_BY_COMMITS) + " SELECT rank, path, commits, lines FROM best",
    "churn_sort_init": _TOP.format(o="first_seen, path") + " SELECT rank, path, commits, lines, first_seen FROM best",
    "churn_filters": f"""WITH {_LOG}, l2 AS (SELECT row_number() OVER (ORDER BY commit_idx) - 1 AS commit_idx, author, o_orderkey FROM log WHERE contains(lower(author), '_1') OR contains(lower(author), 'n_2')),
chg AS (SELECT commit_idx, min(l_linenumber) AS pos, lower(p_type) || '/' || p_brand || '/' || p_name AS path, CAST(sum(l_quantity) AS BIGINT) AS changes FROM lineitem JOIN part ON l_partkey = p_partkey JOIN l2 ON l_orderkey = o_orderkey GROUP BY 1, 3),
fc AS (SELECT path, count(*) AS commits, CAST(sum(changes) AS BIGINT) AS lines, min(commit_idx) AS first_seen, arg_min(pos, commit_idx * 1000 + pos) AS first_pos FROM chg
 WHERE (path LIKE 'economy/%' OR path LIKE '%copper%') AND path NOT LIKE '%Brand#1%' GROUP BY path HAVING sum(changes) >= 40)
SELECT row_number() OVER (ORDER BY {_BY_LINES}) AS rank, path, commits, lines, first_seen FROM fc QUALIFY rank <= 20""",
    "churn_auto_bucket": f"WITH {_LOG}, {_SIZE} SELECT * FROM spans",
    "churn_heatmap": _TOP.format(o=_BY_LINES) + f", {_SIZE}, cells AS (SELECT path, commit_idx // bucket_size AS bucket, sum(changes) AS v FROM chg CROSS JOIN spans WHERE path IN (SELECT path FROM best) GROUP BY ALL), {_shades('cells', 'path')} SELECT rank, path, commits, lines, h AS history FROM best JOIN hist USING (path)",
    "churn_author_activity": _chg() + f""", {_SIZE}, au AS (SELECT author, count(*) AS commits FROM log GROUP BY author), al AS (SELECT author, CAST(sum(changes) AS BIGINT) AS lines FROM chg WHERE path LIKE 'economy/%' GROUP BY author),
best AS (SELECT author, commits, coalesce(lines, 0) AS lines FROM au LEFT JOIN al USING (author) ORDER BY commits DESC, lines DESC, author LIMIT 10),
cells AS (SELECT author, commit_idx // bucket_size AS bucket, count(*) AS v FROM log CROSS JOIN spans WHERE author IN (SELECT author FROM best) GROUP BY ALL), {_shades('cells', 'author')}
SELECT author, commits, lines, h AS activity FROM best JOIN hist USING (author)""",
    "churn_sustained": _chg() + f""", {_SIZE}, pb AS (SELECT path, commit_idx // bucket_size AS bucket, sum(changes) AS v, any_value(num_buckets) AS nb FROM chg CROSS JOIN spans GROUP BY ALL),
ct AS (SELECT path, count(*) FILTER (WHERE v > 0) AS active, any_value(nb) - min(bucket) AS possible FROM pb GROUP BY path HAVING any_value(nb) - min(bucket) >= 2 AND any_value(nb) >= 3)
SELECT path, active, possible, round(active / possible, 6) AS continuity, commits, lines FROM ct JOIN fc USING (path) WHERE active / possible >= 0.25 ORDER BY active / possible DESC, lines DESC, path LIMIT 94""",
    "churn_summary": _chg() + " SELECT path, commits, lines FROM fc",
    "churn_summary_json": _chg() + " SELECT path, commits, lines FROM fc",
    "churn_log_parse": _chg() + " SELECT commit_idx, author, path, changes FROM chg",
    "continuity_40": _chg() + """, sp AS (SELECT greatest(1, CAST(round_even(count(*) / 40.0, 0) AS BIGINT)) AS s, count(*) AS n FROM log), nb AS (SELECT s, CAST(ceil(n / s) AS BIGINT) AS nb FROM sp)
SELECT path, round(count(DISTINCT commit_idx // s) / (any_value(nb) - min(commit_idx // s)), 6) AS continuity FROM chg CROSS JOIN nb GROUP BY path""",
    "cochange_pairs": _PAIRS.format(chg=_chg("p_type"), t=0.3) + " SELECT a, b, co_commits, round(coupling, 6) AS coupling FROM pairs",
    "cochange_clusters": _CLUSTERS.format(chg=_chg("p_type"), t=0.33) + " SELECT root, path, size, round(avg_coupling, 6) AS avg_coupling, n_edges FROM comp JOIN cl USING (root) JOIN cs USING (root)",
    "cochange_cluster_report": _CLUSTERS.format(chg=_chg("p_type"), t=0.3) + """, o AS (SELECT row_number() OVER (ORDER BY size DESC, avg_coupling DESC, root) AS cluster, root, size, avg_coupling, n_edges FROM cl JOIN cs USING (root)),
u AS (SELECT *, 3 + sum(size + 8 + least(10, n_edges)) OVER (ORDER BY cluster) AS upto FROM o) SELECT cluster, root, size, round(avg_coupling, 6) AS avg_coupling, n_edges FROM u WHERE cluster = 1 OR upto <= 100""",
}
