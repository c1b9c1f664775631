"""URL filters: a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpoint

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda s: s != "")


def _key(labels: Column, segs: Column, n_labels: int | Column, n_segs: int | Column) -> Column:
    """The last labels of a host, and the first segments of a path."""
    host = F.array_join(F.slice(labels, F.size(labels) - F.lit(n_labels) + 1, F.lit(n_labels)), ".")
    return F.array_join(F.concat(F.array(host), F.slice(segs, F.lit(1), F.lit(n_segs))), "/")


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (key, category, valid_from, valid_to, labels, segs) from dated entries (key, category, action, at).

    ``action`` is add or remove; each entry holds until the next of its key and category, and the
    last one for ever (null). Of entries at the same instant, a removal stands. An interval in
    which the key isn't listed is dropped; adjoining intervals of repeated adds are equivalent to
    one. Keys are hosts, or hosts with a path prefix, compared in lower case without a leading
    ``www.``; entries with a null or empty key, or a null action or date, are dropped. ``labels`` and ``segs``
    are how many labels the host and segments the path has.
    """
    raw = F.regexp_replace(F.lower(F.trim("key")), r"^www\.", "")
    labels, segs = F.split(F.substring_index(raw, "/", 1), r"\."), _segments(F.when(raw.contains("/"), F.regexp_replace(raw, "^[^/]*", "")).otherwise(""))
    e = entries.select(
        _key(labels, segs, F.size(labels), F.size(segs)).alias("key"), F.size(labels).alias("labels"), F.size(segs).alias("segs"), F.coalesce("category", F.lit("")).alias("category"),
        F.lower(F.trim("action")).alias("action"), F.col("at").cast("timestamp_ntz").alias("at"),
    ).filter((F.col("key") != "") & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    e = e.groupBy("key", "category", "at").agg(F.max("action").alias("action"), F.max("labels").alias("labels"), F.max("segs").alias("segs"))
    w = Window.partitionBy("key", "category").orderBy("at")
    e = e.withColumn("valid_to", F.lead("at").over(w)).filter(F.col("action") == "add")
    return e.select("key", "category", F.col("at").alias("valid_from"), "valid_to", "labels", "segs")


def url_keys(url: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """Keys of a list that can list a URL, one for each of the list's shapes (labels, segments); null where the URL is shorter.

    A URL has as many keys as the list has shapes, however many labels and segments it has itself.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.|\.$", "")
    labels, segs = F.split(host, r"\."), _segments(F.regexp_extract(url, _PATH, 1))
    return [F.when((host != "") & (F.size(labels) >= n) & (F.size(segs) >= m), _key(labels, segs, n, m)) for n, m in shapes]


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(id, url, fetched_at, blocked, categories, matched_key, listed_since) for every capture.

    Entries become intervals (:func:`validity`); a capture is blocked if one of its keys
    (:func:`url_keys`) was listed at fetch time: an as-of join on the key, of which the intervals
    that hold at that time are taken. ``matched_key`` is the longest such key (then the least), and
    ``listed_since`` its latest ``valid_from``.

    A list of at most ``broadcast_bytes`` goes to all tasks, by key, and captures stay where they are: one
    lookup for each shape of keys. A larger one meets the keys of distinct (url, time) pairs by a shuffle, whose skew is
    handled adaptively, and what is found is joined to the captures.

    A null or malformed url, or a null time, is not blocked. Captures keep their repeated
    rows and null ids; an empty list blocks nothing; of a very long URL only the keys are taken that the list may have;
    an empty table gives no rows. Other columns are not returned.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp_ntz").alias("t"))
    v = checkpoint(validity(entries))
    about = v.agg(F.coalesce(F.sum(F.length("key") + F.length("category") + 48), F.lit(0)).alias("bytes"), F.collect_set(F.struct("labels", "segs")).alias("shapes")).first()
    shapes = sorted((r["labels"], r["segs"]) for r in about["shapes"])
    keys = url_keys(F.col("url"), shapes)
    if about["bytes"] <= broadcast_bytes:
        listed = F.broadcast(v.groupBy("key").agg(F.collect_list(F.struct("category", "valid_from", "valid_to")).alias("spans")))
        found, hits = c, []
        for n, key in enumerate(keys):
            found = found.withColumn(f"k{n}", key).join(listed.select(F.col("key").alias(f"key{n}"), F.col("spans").alias(f"spans{n}")), F.col(f"k{n}") == F.col(f"key{n}"), "left")
            active = F.filter(f"spans{n}", lambda x: (x["valid_from"] <= F.col("t")) & (x["valid_to"].isNull() | (x["valid_to"] > F.col("t"))))
            own = F.col(f"k{n}")
            hits.append(F.coalesce(F.transform(active, _hit_of(own)), F.array().cast(_HITS)))
        found = found.withColumn("hits", F.concat(*hits) if hits else F.array().cast(_HITS))
        out = found.withColumn("categories", F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["category"])))).withColumn("m", F.array_min("hits"))
    else:
        keyed = c.select("url", "t").distinct().withColumn("key", F.explode(F.array_compact(F.array(*keys)))).distinct()
        hit = keyed.join(v, (keyed["key"] == v["key"]) & (keyed["t"] >= v["valid_from"]) & (v["valid_to"].isNull() | (keyed["t"] < v["valid_to"])))
        best = hit.groupBy("url", "t").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.min(_hit(keyed["key"], F.col("valid_from"), F.col("category"))).alias("m"))
        best = best.withColumnsRenamed({"url": "u", "t": "ft"})
        out = c.join(best, (c["url"] == best["u"]) & (c["t"] == best["ft"]), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t").alias(time_col), F.col("m.k").isNotNull().alias("blocked"),
        F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"), F.col("m.k").alias("matched_key"), F.col("m.at").alias("listed_since"),
    )


_HITS = "array<struct<n:int,k:string,since:bigint,at:timestamp_ntz,category:string>>"


def _hit(key: Column, at: Column, category: Column) -> Column:
    """The least of these is of the longest key, then the least, then the latest."""
    return F.struct((-F.length(key)).alias("n"), key.alias("k"), (-F.unix_micros(at.cast("timestamp"))).alias("since"), at.alias("at"), category.alias("category"))


def _hit_of(key: Column):
    return lambda span: _hit(key, span["valid_from"], span["category"])
