"""The shared test tables seen as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import dense_ordinal
from ..session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a small file is one task, however much is made of each of its rows.

    It is a checkpoint, as filters would be moved before the repartition with all that they compute.
    """
    spark = df.sparkSession
    return checkpoint(df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_idx, author, o_orderkey): orders with lines in order of date and key; the author is the customer's nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    live = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = live.join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", F.col("n_name").alias("author"))
    return dense_ordinal(named, F.col("o_orderdate"), [F.col("o_orderkey")], "commit_idx").select("commit_idx", "author", "o_orderkey")


def changes(spark: SparkSession, sf_dir: str, path: str = "part", log: DataFrame | None = None) -> DataFrame:
    """(commit_idx, author, pos, path, changes): an order's lines by path, a part's place in a tree (or its ``type``)."""
    log = commits(spark, sf_dir) if log is None else log
    expr = F.col("p_type") if path == "type" else F.concat_ws("/", F.lower("p_type"), "p_brand", "p_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", expr.alias("path"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "path").agg(F.min("l_linenumber").alias("pos"), F.sum("l_quantity").cast("bigint").alias("changes"))
    return rows.join(log, F.col("l_orderkey") == F.col("o_orderkey")).select("commit_idx", "author", "pos", "path", "changes")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): documents as files, by source and language."""
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, path, line, end, kind, signature, scope): conversations as outer spans, turns as inner ones."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations")
    n = F.size(F.split("text", "\n"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    turns = t.withColumn("n", n).withColumn("end", F.sum("n").over(w) + 1).withColumn("line", F.col("end") - F.col("n") + 1)
    path = F.concat(F.lit("conv"), (F.col("conv_id") % 10).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".py"))
    inner = turns.select(
        F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("name"), path.alias("path"), F.col("line").cast("int").alias("line"),
        F.when(F.col("turn") % 3 != 2, F.col("end").cast("int")).alias("end"), F.when(F.col("role") == "user", "function").otherwise("member").alias("kind"),
        F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("signature"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("scope"),
    )
    outer = turns.groupBy("conv_id").agg(F.max("end").alias("stop")).select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("name"), path.alias("path"), F.lit(1).alias("line"), F.col("stop").cast("int").alias("end"),
        F.lit("class").alias("kind"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("scope"),
    )
    return outer.unionByName(inner)


def nation_edges(spark: SparkSession, sf_dir: str, per: int = 2) -> DataFrame:
    """(src, dst): each customer nation's ``per`` greatest supplier nations by revenue (cents), itself left out."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("from"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "from")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("to"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    sums = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "from", "cents").join(supp, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("from", "to").agg(F.sum("cents").alias("r"))
    names = lambda key, name: n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    rev = sums.join(names("from", "src"), "from").join(names("to", "dst"), "to").groupBy("src", "dst").agg(F.sum("r").alias("r")).filter("src <> dst")
    return rev.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("r"), "dst"))).filter(F.col("k") <= per).select("src", "dst")


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, cell_type, source): conversations as notebooks, turns as cells."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "code").when(F.col("role") == "assistant", "markdown").otherwise("raw")
    return t.select(F.concat(F.lit("nb/"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.col("turn").alias("pos"), kind.alias("cell_type"), F.col("text").alias("source"))
