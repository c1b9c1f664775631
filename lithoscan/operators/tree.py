"""Directories: roll-ups, trees and budgeted views. Files are (path, loc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .imports import ancestors
from .text import extension


def log2_of(c: Column, per: float = 1.0) -> Column:
    return F.log2(F.lit(1.0) + c / F.lit(per))


def directory_importance(files: Column, loc: Column, churn: Column | None = None, hot: Column | None = None) -> Column:
    if churn is None:
        return (log2_of(files) + log2_of(loc, 100.0)) * 0.5
    return log2_of(files) * 0.4 + log2_of(loc, 100.0) * 0.2 + log2_of(churn, 100.0) * 0.25 + log2_of(hot) * 0.15


def file_importance(loc: Column, commits: Column | None = None, lines: Column | None = None) -> Column:
    if commits is None:
        return log2_of(loc, 100.0)
    return log2_of(lines, 100.0) * 0.4 + log2_of(commits) * 0.35 + log2_of(loc, 100.0) * 0.25


def directory_stats(files: DataFrame, churn: DataFrame | None = None, hot: int = 2) -> DataFrame:
    """A row for each directory, over all files below it; ``churn`` is (path, commits, lines).

    Every file is exploded to its ancestors and summed once, so that each level needs no pass of
    its own. ``hot_files`` are those of most changed lines.
    """
    f = files if churn is None else files.join(churn.select("path", "commits", F.col("lines").alias("changed")), "path", "left")
    up = f.withColumn("dir", F.explode(ancestors(F.col("path"))))
    depth = F.size(F.split("dir", "/"))
    child = F.concat_ws("/", F.slice(F.split("path", "/"), 1, depth + 1))
    aggs = [F.count("*").alias("file_count"), F.sum("loc").alias("total_loc"), F.count_distinct(child).alias("direct_children")]
    if churn is None:
        return up.groupBy("dir").agg(*aggs).withColumn("importance", directory_importance(F.col("file_count"), F.col("total_loc")))
    hottest = F.expr(f"transform(slice(sort_array(collect_list(CASE WHEN changed IS NOT NULL THEN struct(-changed AS k, path) END)), 1, {int(hot)}), x -> x.path)")
    aggs += [F.coalesce(F.sum("commits"), F.lit(0)).alias("churn_commits"), F.coalesce(F.sum("changed"), F.lit(0)).alias("churn_lines"), F.count("changed").alias("hot_count"), hottest.alias("hot_files")]
    return up.groupBy("dir").agg(*aggs).withColumn("importance", directory_importance(F.col("file_count"), F.col("total_loc"), F.col("churn_lines"), F.col("hot_count")))


def nodes(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, parent, name, depth, is_dir, loc): the files and directories of the tree."""
    own = files.select("path", F.lit(False).alias("is_dir"), "loc")
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("bigint").alias("loc"))
    p = F.col("path")
    n = own.unionByName(dirs).select("path", F.regexp_replace(p, r"/?[^/]*$", "").alias("parent"), F.substring_index(p, "/", -1).alias("name"), F.size(F.split(p, "/")).alias("depth"), "is_dir", "loc")
    return n if max_depth is None else n.filter(F.col("depth") <= max_depth)


def tree_lines(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, line): the tree drawn with box characters, in the order of ``path`` by segments.

    Whether a node and each of its ancestors is the last of its siblings decides the glyphs.
    """
    n = nodes(files, max_depth)
    w = Window.partitionBy("parent").orderBy(F.desc("name"))
    n = n.withColumn("last", F.row_number().over(w) == 1)
    flags = n.filter("is_dir").select(F.col("path").alias("dir"), F.col("last").alias("dir_last"))
    up = n.select("path", F.posexplode_outer(ancestors(F.col("path"))).alias("pos", "dir")).join(flags, "dir", "left")
    lead = up.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "dir_last")))), lambda x: F.when(x["dir_last"], "    ").otherwise("│   ")), "").alias("lead"))
    j = n.join(lead, "path")
    shown = F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.concat("name", F.coalesce(F.concat(F.lit(" ("), F.col("loc").cast("string"), F.lit(")")), F.lit(""))))
    return j.select("path", F.concat("lead", F.when(F.col("last"), "└── ").otherwise("├── "), shown).alias("line"))


def expand_budgeted(files: DataFrame, budget: int, churn: DataFrame | None = None) -> DataFrame:
    """(path, state, hidden): what a view of at most ``budget`` lines shows.

    State is file, expanded, partial (with ``hidden`` children left out) or collapsed. The root's
    children show; then, while lines remain, the most important collapsed directory is expanded,
    and the first that doesn't fit shows its best children and one line for the others.

    A directory is at least as important as those in it, so that the greedy choice is the order of
    importance and path itself: directories are sorted by it, and the driver reads them one by one until one doesn't fit.
    """
    spark = files.sparkSession
    stats = directory_stats(files, churn)
    n = nodes(files)
    used = n.filter("parent = ''").count()
    opened, partial = [], None
    ordered = stats.select("dir", "importance", "direct_children").orderBy(F.desc("importance"), "dir")
    for r in ordered.toLocalIterator() if used < budget else ():
        if used + r["direct_children"] - 1 <= budget:
            opened.append(r["dir"])
            used += r["direct_children"] - 1
            if used >= budget:
                break
            continue
        if budget - used + 1 >= 2:
            partial = (r["dir"], budget - used, r["direct_children"] - (budget - used))
        break
    own = spark.createDataFrame([(d, "expanded", 0) for d in opened] + ([(partial[0], "partial", partial[2])] if partial else []), "path string, own string, hidden int")
    seen = spark.createDataFrame([("",), *((d,) for d in opened)], "parent string")
    inside = n.join(seen, "parent", "left_semi").select("path", "is_dir")
    out = inside.join(own, "path", "left").select("path", F.coalesce("own", F.when(F.col("is_dir"), "collapsed").otherwise("file")).alias("state"), F.coalesce("hidden", F.lit(0)).alias("hidden"))
    if partial:
        rank = stats.select(F.col("dir").alias("path"), "importance")
        best = n.filter(F.col("parent") == partial[0]).join(rank, "path", "left").withColumn("v", F.coalesce("importance", F.col("loc") / 1000.0, F.lit(0.0))).orderBy(F.desc("v"), "path").limit(partial[1])
        out = out.unionByName(best.select("path", F.when(F.col("is_dir"), "collapsed").otherwise("file").alias("state"), F.lit(0).alias("hidden")))
    return out


def top_directory_summary(files: DataFrame, tags: DataFrame | None = None, readme: DataFrame | None = None) -> DataFrame:
    """(dir, files, types, symbols, description) for each first directory; ``tags`` give unscoped names in order."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    t = files.select(top.alias("dir"), extension(F.col("path")).alias("ext"))
    kinds = t.groupBy("dir", "ext").agg(F.count("*").alias("n"))
    out = kinds.groupBy("dir").agg(F.sum("n").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("types"))
    if tags is not None:
        s = tags.filter(F.coalesce("scope", F.lit("")) == "").select(top.alias("dir"), F.struct("path", "line", "name").alias("s"))
        names = s.groupBy("dir").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["name"])).alias("symbols"))
        out = out.join(names, "dir", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
    if readme is not None:
        out = out.join(readme.filter(F.lower("path").rlike(r"^[^/]+/readme(\.md)?$")).select(F.substring_index("path", "/", 1).alias("dir"), F.col("summary").alias("description")), "dir", "left")
    return out
