"""Change intensity over a commit log.

``commits`` is (commit_idx, author), one row a commit, index 0 the oldest; ``changes`` is
(commit_idx, author, pos, path, changes), one row for each path that a commit touches.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .graph import connected_components
from .ordering import STRETCH, dense_ordinal, running_count

SHADES = " ░▒▓█"
MAX_PATHS_PER_COMMIT = 50
MIN_CO_COMMITS = 2


def parse_numstat(lines: DataFrame, order: str = "line_no", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(commits, changes) from log lines: ``COMMIT<tab>author`` headers, then add<tab>del<tab>path.

    Lines come newest commit first. A header opens a session that runs to the next header, found by
    a running count; a commit without any countable row has no index. Rows with ``-`` (binary) drop.
    """
    header = F.col(text).startswith("COMMIT\t")
    s = running_count(lines, header, order, "session").filter("session > 0")
    parts = F.split(text, "\t", 3)
    rows = s.select("session", F.col(order).alias("line"), header.alias("is_header"), F.regexp_replace(F.col(text), r"^COMMIT\t", "").alias("author"), parts.alias("p"))
    heads = rows.filter("is_header").select("session", "author")
    stat = rows.filter(~F.col("is_header") & (F.size("p") == 3)).select(
        "session", "line", F.expr("try_cast(p[0] AS bigint)").alias("a"), F.expr("try_cast(p[1] AS bigint)").alias("d"), F.regexp_replace(F.col("p")[2], '^"(.*)"$', "$1").alias("path")
    ).filter("a IS NOT NULL AND d IS NOT NULL")
    live = dense_ordinal(stat.select("session").distinct(), -F.floor(F.col("session") / STRETCH), [F.desc("session")], "commit_idx").join(heads, "session")
    changes = stat.join(live, "session").select("commit_idx", "author", F.col("line").alias("pos"), "path", (F.col("a") + F.col("d")).alias("changes"))
    return live.select("commit_idx", "author"), changes


def auto_bucket_size(n: Column) -> Column:
    """Commits a bucket: about 50 buckets, kept between 30 and 60; 1 up to 60 commits."""
    size = F.greatest(F.lit(1), F.bround(n / 50.0)).cast("bigint")
    buckets = F.ceil(n / size)
    return (
        F.when(n <= 60, F.lit(1)).when(buckets > 60, F.greatest(F.lit(1), F.ceil(n / 60.0)))
        .when(buckets < 30, F.greatest(F.lit(1), F.floor(n / 30.0))).otherwise(size).cast("bigint")
    )


def buckets(commits: DataFrame, size: int | None = None) -> DataFrame:
    """One row: n_commits, bucket_size, num_buckets."""
    n = commits.agg(F.count("*").alias("n_commits"))
    s = auto_bucket_size(F.col("n_commits")) if size is None else F.lit(size).cast("bigint")
    return n.withColumn("bucket_size", s).withColumn("num_buckets", F.ceil(F.col("n_commits") / F.col("bucket_size")).cast("bigint"))


def glob_filter(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Any include and no exclude; ``*`` crosses slashes."""

    def any_of(globs: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | path.rlike("^" + fnmatch.translate(g).replace(r"\z", "$").replace(r"\Z", "$"))
        return out

    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def author_filter(author: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(not needles)
    for x in needles:
        out = out | F.lower(author).contains(x.lower())
    return out


def by_authors(commits: DataFrame, changes: DataFrame, needles: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Only these authors' commits, numbered anew."""
    kept = commits.filter(author_filter(F.col("author"), needles))
    renumbered = dense_ordinal(kept, F.floor(F.col("commit_idx") / STRETCH), [F.col("commit_idx")], "new_idx")
    c = renumbered.select(F.col("new_idx").cast("bigint").alias("commit_idx"), "author")
    return c, changes.join(renumbered.select("commit_idx", "new_idx"), "commit_idx").withColumn("commit_idx", F.col("new_idx").cast("bigint")).drop("new_idx")


def file_churn(changes: DataFrame) -> DataFrame:
    """(path, commits, lines, first_seen, first_pos)."""
    return changes.groupBy("path").agg(
        F.count("*").alias("commits"), F.sum("changes").alias("lines"), F.min("commit_idx").alias("first_seen"), F.min(F.struct("commit_idx", "pos"))["pos"].alias("first_pos"),
    )


def top_files(churn: DataFrame, sort: str = "lines", top: int = 20, min_lines: int = 0) -> DataFrame:
    """The ``top`` paths with their rank; ties by first appearance (by path for ``init``)."""
    if sort not in ("lines", "commits", "init"):
        raise ValueError(f"sort must be lines, commits or init, not {sort}")
    seen = [F.asc("first_seen"), F.asc("first_pos"), F.asc("path")]
    order = {"lines": [F.desc("lines"), *seen], "commits": [F.desc("commits"), F.desc("lines"), *seen], "init": [F.asc("first_seen"), F.asc("path")]}[sort]
    kept = churn.filter(F.col("lines") >= min_lines) if min_lines > 0 else churn
    best = kept.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vectors(events: DataFrame, key: str, value: Column, spans: DataFrame) -> DataFrame:
    """(key, vec): sums of ``value`` by time bucket as a dense array."""
    b = events.crossJoin(F.broadcast(spans)).withColumn("bucket", F.floor(F.col("commit_idx") / F.col("bucket_size")))
    sums = b.groupBy(key, "bucket").agg(F.sum(value).alias("v"), F.first("num_buckets").alias("nb"))
    packed = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"), F.first("nb").alias("nb"))
    return packed.select(key, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("vec"))


def shade(vec: Column, peak: Column) -> Column:
    """One glyph a bucket; blank for nothing, the darkest for the peak."""
    glyph = lambda v: F.when(v == 0, F.lit(SHADES[0])).otherwise(F.substring(F.lit(SHADES), F.least(F.lit(5), F.floor(v / peak * 3) + 2).cast("int"), F.lit(1)))
    return F.array_join(F.transform(vec, glyph), "")


def heatmap(commits: DataFrame, changes: DataFrame, sort: str = "lines", top: int = 20, min_lines: int = 0, bucket_size: int | None = None) -> DataFrame:
    """The top files with a history of shaded buckets, relative to the greatest bucket shown."""
    best = top_files(file_churn(changes), sort, top, min_lines)
    v = vectors(changes.join(F.broadcast(best.select("path")), "path", "left_semi"), "path", F.col("changes"), buckets(commits, bucket_size))
    j = best.join(v, "path")
    peak = F.greatest(F.max(F.array_max("vec")).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return j.select("rank", "path", "commits", "lines", shade(F.col("vec"), peak).alias("history"))


def author_activity(commits: DataFrame, changes: DataFrame, top: int = 10, bucket_size: int | None = None) -> DataFrame:
    """The ``top`` authors: commits count even where path filters leave no line of them."""
    n = commits.groupBy("author").agg(F.count("*").alias("commits"))
    lines = changes.groupBy("author").agg(F.sum("changes").alias("lines"))
    order = [F.desc("commits"), F.desc("lines"), F.asc("author")]
    best = n.join(lines, "author", "left").fillna(0, ["lines"]).orderBy(*order).limit(top)
    v = vectors(commits.join(F.broadcast(best.select("author")), "author", "left_semi"), "author", F.lit(1).cast("bigint"), buckets(commits, bucket_size))
    j = best.join(v, "author")
    peak = F.greatest(F.max(F.array_max("vec")).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return j.select("author", "commits", "lines", shade(F.col("vec"), peak).alias("activity"))


def continuity(commits: DataFrame, changes: DataFrame, bucket_size: int | None = None) -> DataFrame:
    """(path, active, possible, continuity, commits, lines): share of buckets with changes since the first."""
    spans = buckets(commits, bucket_size)
    b = changes.crossJoin(F.broadcast(spans)).withColumn("bucket", F.floor(F.col("commit_idx") / F.col("bucket_size")))
    per = b.groupBy("path", "bucket").agg(F.sum("changes").alias("v"), F.count("*").alias("n"), F.first("num_buckets").alias("nb"))
    out = per.groupBy("path").agg(
        F.count_if(F.col("v") > 0).alias("active"), (F.first("nb") - F.min("bucket")).alias("possible"), F.sum("n").alias("commits"), F.sum("v").alias("lines"), F.first("nb").alias("nb")
    )
    return out.filter("possible >= 2 AND nb >= 3").withColumn("continuity", F.col("active") / F.col("possible")).drop("nb")


def sustained(commits: DataFrame, changes: DataFrame, min_continuity: float = 0.25, rows: int = 94, bucket_size: int | None = None) -> DataFrame:
    c = continuity(commits, changes, bucket_size).filter(F.col("continuity") >= min_continuity)
    return c.orderBy(F.desc("continuity"), F.desc("lines"), F.asc("path")).limit(rows)


def presence_continuity(commits: DataFrame, changes: DataFrame, target: int = 40) -> DataFrame:
    """(path, continuity) over about ``target`` buckets, counting presence; a lone bucket counts."""
    n = commits.agg(F.count("*").alias("n"))
    spans = n.withColumn("size", F.greatest(F.lit(1), F.bround(F.col("n") / float(max(1, target)))).cast("bigint")).withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("size"))))
    b = changes.crossJoin(F.broadcast(spans)).withColumn("bucket", F.floor(F.col("commit_idx") / F.col("size")))
    per = b.groupBy("path").agg(F.count_distinct("bucket").alias("active"), (F.first("nb") - F.min("bucket")).alias("possible"))
    return per.filter("possible > 0").select("path", (F.col("active") / F.col("possible")).alias("continuity"))


def churn_summary(changes: DataFrame) -> DataFrame:
    return file_churn(changes).select("path", "commits", "lines")


def summary_json(changes: DataFrame) -> DataFrame:
    """One row: {path: {commits, lines}} as JSON."""
    e = churn_summary(changes).select(F.struct(F.col("path"), F.struct("commits", "lines")).alias("e"))
    return e.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("json"))


def read_summary_json(df: DataFrame, col: str = "json") -> DataFrame:
    m = F.from_json(F.col(col), "map<string,struct<commits:bigint,lines:bigint>>")
    return df.select(F.explode(m).alias("path", "v")).select("path", "v.commits", "v.lines")


def cochange_pairs(changes: DataFrame, min_coupling: float = 0.3, max_paths: int = MAX_PATHS_PER_COMMIT, min_commits: int = MIN_CO_COMMITS) -> DataFrame:
    """(a, b, co_commits, coupling), a < b: paths that change together.

    Commits of more than ``max_paths`` paths don't count for pairs, though they do for each path's
    own commits; without this guard the pairs of one commit grow with its square.
    """
    # all by one shuffle; the paths of a commit come together only if they are few
    touched = changes.select("commit_idx", "path").filter("commit_idx IS NOT NULL").repartition("commit_idx").distinct()
    sized = touched.withColumn("n", F.count("*").over(Window.partitionBy("commit_idx"))).filter((F.col("n") >= 2) & (F.col("n") <= max_paths))
    basket = sized.groupBy("commit_idx").agg(F.array_sort(F.collect_list("path")).alias("p"))
    firsts = basket.select("p", F.posexplode("p").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("co_commits")).filter(F.col("co_commits") >= min_commits)
    n = changes.groupBy("path").agg(F.count("*").alias("n"))
    j = pairs.join(n.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return j.withColumn("coupling", F.col("co_commits") / (F.col("na") + F.col("nb") - F.col("co_commits"))).filter(F.col("coupling") >= min_coupling).select("a", "b", "co_commits", "coupling")


def cochange_clusters(pairs: DataFrame) -> DataFrame:
    """(root, path, size, avg_coupling): connected components of the coupled pairs."""
    pairs = checkpoint(pairs)  # both uses are of one
    comp = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    avg = pairs.join(comp, pairs["a"] == comp["node"]).groupBy("root").agg(F.avg("coupling").alias("avg_coupling"), F.count("*").alias("n_edges"))
    size = comp.groupBy("root").agg(F.count("*").alias("size"))
    return comp.join(size, "root").join(avg, "root").select("root", F.col("node").alias("path"), "size", "avg_coupling", "n_edges")


def clusters_within(clusters: DataFrame, lines: int = 100) -> DataFrame:
    """Clusters in order of size and coupling whose printed lines fit the budget; the first always does."""
    one = clusters.groupBy("root", "size", "avg_coupling", "n_edges").agg(F.count("*").alias("_"))
    order = [F.desc("size"), F.desc("avg_coupling"), F.asc("root")]
    w = Window.orderBy(*order)
    need = one.withColumn("cluster", F.row_number().over(w)).withColumn("need", F.col("size") + 8 + F.least(F.lit(10), F.col("n_edges")))
    total = need.withColumn("upto", F.lit(3) + F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return total.filter((F.col("cluster") == 1) | (F.col("upto") <= lines)).select("cluster", "root", "size", "avg_coupling", "n_edges")
