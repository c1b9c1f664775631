"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import checkpoint, fresh, if_small, slices, text_batches, utf8

#: Hashed features; byte n-grams of 2 and 3, over lower-cased words with one blank between them.
DIM = 4096
#: Size classes: binary orders of a text's bytes.
CLASSES = 32
#: Documents, or held-out cuts, that a (language, size class) needs for quartiles of its own.
LEAST = 50
#: The size class from which distances don't change with length.
LONG = 17
_LOW = np.full(256, 32, np.uint32)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _LOW[_b] = _b
    elif 65 <= _b <= 90:
        _LOW[_b] = _b + 32


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text."""
    rows = len(offsets) - 1
    low = _LOW[data]
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    blank = low == 32
    if len(low) > 1:  # runs of blanks count as one
        keep = np.ones(len(low), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
        low, row = low[keep], row[keep]
    out = np.zeros(rows * DIM, np.int64)
    base = row * DIM
    if len(low) > 1:
        two = low[:-1] << np.uint32(8) | low[1:]
        same = row[:-1] == row[1:]
        h = (two * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(base[:-1][same] + h[same], minlength=len(out))
    if len(low) > 2:
        three = (two[:-1] << np.uint32(8) | low[2:]) + np.uint32(0x51000000)
        same = row[:-2] == row[2:]
        h = (three * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(base[:-2][same] + h[same], minlength=len(out))
    return out.reshape(rows, DIM)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (0 for a text without letters)."""
    x = np.log1p(counts.astype(np.float32)) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray  # index of a centroid's language
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    expected: np.ndarray  # by language and size class: quartiles and bound of the distance, by held-out cuts

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and cosine distance from its nearest centroid."""
        sim = x @ self.centroids.T
        best = sim.argmax(axis=1)
        return self.owner[best], 1.0 - sim[np.arange(len(x)), best]


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over the whole table; and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for _, _, data, off in text_batches(b, "text"):
                df += (gram_counts(data, off) > 0).sum(axis=0)
                n += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM), pa.int32()), pa.array(np.concatenate([[n], df]))], ["f", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIM, np.int64), 0
    for f, c in got:
        if f < 0:
            n = c
        else:
            df[f] = c
    return df, n


def cluster(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means: up to k unit centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def cuts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bytes, offsets and text numbers of pieces of each text, one of each size class up to its own, from changing places.

    Behind the first so many (the last result) are pieces of texts put together, for the classes up
    to ``LONG`` of which there are few: of even texts with number 0, of odd ones with 1.
    """
    data, off = utf8(pa.array(texts, pa.string()))
    parts, of = [], []
    for i in range(len(texts)):
        raw = data[off[i] : off[i + 1]]
        for c in range(len(raw).bit_length()):
            n = min(len(raw), int(2**c * (1 + i * 0.618034 % 1)))
            at = int((len(raw) - n) * (i * 0.414214 % 1))
            if (_LOW[raw[at : at + n]] != 32).any():
                parts.append(raw[at : at + n])
                of.append(i)
    whole = len(parts)
    n = np.bincount([len(p).bit_length() - 1 for p in parts], minlength=CLASSES)
    for h in (0, 1):
        joined = np.concatenate([data[off[i] : off[i + 1]] for i in range(min(h, len(texts) - 1), len(texts), 2)])
        for c in np.flatnonzero(n[: LONG + 1] < 10):
            for k in range(5):
                parts.append(np.resize(np.roll(joined, -k * len(joined) // 5), int(2**c * (1 + k / 5))))
                of.append(h)
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(of, np.int64), whole


def expect(samples: list[list[str]], halves: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """By language and size class: the quartiles of its texts' distances, and the bound of a fence.

    Measured on cuts of the labelled texts, each against centroids of the half of the sample
    that it isn't in. The bound is the 5 % quantile of the distances of other languages' texts,
    which are what unrelated text is at that length; where languages are so close that this
    would reject their own texts, their 95 % quantile. With a single language, its texts with
    their bytes in another order are the unrelated ones.
    A class with too few cuts takes the figures of the nearest one that has enough.
    """
    k, rng = len(samples), np.random.default_rng(7)
    dist: list[list[np.ndarray]] = [[] for _ in range(2 * k)]  # own, others'
    size: list[list[np.ndarray]] = [[] for _ in range(2 * k)]
    for lang, texts in enumerate(samples):
        data, off, of, whole = cuts(texts)
        for i, j in slices(off):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            c = np.floor(np.log2(np.diff(at))).astype(np.int64)
            x = tfidf(gram_counts(part, at), idf)
            for to in range(k):
                sim = np.stack([(x @ h.T).max(axis=1) for h in halves[to]])
                d = 1.0 - sim[of[i:j] % 2, np.arange(j - i)]
                n = max(0, min(j, whole) - i) if to == lang else j - i
                dist[to if to == lang else k + to].append(d[:n])
                size[to if to == lang else k + to].append(c[:n])
            if k == 1:
                mixed = np.concatenate([rng.permutation(part[a:z]) for a, z in zip(at, at[1:])])
                dist[1].append(1.0 - (tfidf(gram_counts(mixed, at), idf) @ np.concatenate(halves[0]).T).max(axis=1))
                size[1].append(c)

    def by_class(which: int, least: int, q: list[float]) -> np.ndarray:
        d, c = np.concatenate([*dist[which], np.zeros(0)]), np.concatenate([*size[which], np.zeros(0, np.int64)])
        n = np.bincount(c, minlength=CLASSES)
        if not n.any():
            return np.ones((CLASSES, len(q)))
        some = np.flatnonzero(n >= min(least, (n.max() + 1) // 2))
        return np.stack([np.quantile(d[c == some[np.abs(some - t).argmin()]], q) for t in range(CLASSES)])

    out = np.empty((k, CLASSES, 3))
    for lang in range(k):
        own, other = by_class(lang, LEAST, [0.25, 0.75, 0.95]), by_class(k + lang, 10, [0.05])
        out[lang] = np.stack([own[:, 0], own[:, 1], np.maximum(own[:, 2], other[:, 0] - 1e-4)], axis=1)
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 300, per_cluster: int = 4) -> Model | None:
    """Fit on at most ``per_language`` labelled texts of each language, the first by a hash of the text.

    The weights (IDF) come from all documents. None if no text is labelled.
    """
    df, n = document_frequency(docs, text_col)
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    # about four times as many as needed go on to be ordered
    part = if_small(checkpoint(labelled.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count("*")).alias("part"))))
    near = labelled.join(part, "lang").filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < F.col("part")).dropDuplicates(["lang", "h"])
    first = F.expr(f"transform(slice(array_sort(collect_list(struct(pmod(h, 1000003) AS m, h, text))), 1, {int(per_language)}), x -> x.text)")
    rows = sorted((r["lang"], r["t"]) for r in near.groupBy("lang").agg(first.alias("t")).collect())
    if not rows:
        return None
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 1.0
    owner, cents, halves = [], [], []
    for k, (_, texts) in enumerate(rows):
        data, off = utf8(pa.array(texts, pa.string()))
        x = np.concatenate([tfidf(gram_counts(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]])), idf) for i in range(len(texts))])
        c = cluster(x, per_cluster)
        # a text of an even number is held against what the odd ones give, and the other way round
        halves.append(tuple(cluster(x[1 - h :: 2] if len(x) > 1 else x, per_cluster) for h in (0, 1)))
        cents.append(c)
        owner += [k] * len(c)
    return Model([r[0] for r in rows], np.array(owner), np.concatenate(cents).astype(np.float32), idf, expect([r[1] for r in rows], halves, idf))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_id", "distance", "size_class")) -> DataFrame:
    """``docs`` with the nearest language, the cosine distance and the binary order of the text's bytes.

    A text without letters or digits, or a null one, has a null language and distance 1.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs: list[str | None] = []
            dists, size = np.ones(b.num_rows), np.zeros(b.num_rows, np.int32)
            for i, j, data, off in text_batches(b, text_col):
                counts = gram_counts(data, off)
                some = counts.any(axis=1) & (np.add.reduceat(np.append(_LOW[data] != 32, False).astype(np.int64), np.minimum(off[:-1], len(data))) > 0)
                if model is None:
                    langs += [None] * (j - i)
                else:
                    at, d = model.nearest(tfidf(counts, model.idf))
                    dists[i:j] = np.where(some, d, 1.0)
                    langs += [model.languages[a] if s else None for a, s in zip(at.tolist(), some.tolist())]
                size[i:j] = np.floor(np.log2(np.maximum(np.diff(off), 1))).astype(np.int32)
            cols = [*b.columns, pa.array(langs, pa.string()), pa.array(dists), pa.array(size)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def fences(scored: DataFrame, model: Model | None, spread: float, names: tuple[str, str, str] = ("lang_id", "distance", "size_class")) -> DataFrame:
    """(language, size class, fence): the upper quartile plus ``spread`` quartile ranges of all distances, within the bound of :func:`expect`.

    Quartiles come from mergeable sketches over the whole table; a group of under ``LEAST`` rows has
    those of :func:`expect`, and as so few texts don't show how such texts vary, a fence at least halfway to the bound.
    """
    known = [] if model is None else [(la, c, *map(float, model.expected[k, c])) for k, la in enumerate(model.languages) for c in range(CLASSES)]
    known = scored.sparkSession.createDataFrame(known, "lang__f string, size__f int, low double, high double, bound double")
    q = F.percentile_approx(names[1], [0.25, 0.75], 10_000)
    seen = scored.filter(F.col(names[0]).isNotNull()).groupBy(F.col(names[0]).alias("lang__s"), F.col(names[2]).alias("size__s")).agg(q.alias("q"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    both = known.join(seen, (F.col("lang__f") == F.col("lang__s")) & (F.col("size__f") == F.col("size__s")), "left")
    low, high = F.coalesce(F.col("q")[0], "low"), F.coalesce(F.col("q")[1], "high")
    far = high + spread * F.greatest(high - low, F.lit(0.01))
    far = F.when(F.col("n").isNull(), F.greatest(far, (F.col("high") + F.col("bound")) / 2)).otherwise(far)
    return both.select("lang__f", "size__f", F.least(far, "bound").alias("fence__f"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spread: float = 8.0, per_language: int = 300, per_cluster: int = 4) -> DataFrame:
    """(id_col, lang_id, distance, accepted) for every row of ``docs``.

    A text's TF-IDF vector of hashed byte n-grams is compared by cosine with ``per_cluster``
    centroids of each language (:func:`train`). It is rejected, and ``lang_id`` null, if its
    distance from the nearest exceeds the fence of that language and size class (:func:`fences`),
    which stays below the distance of text in other languages (:func:`expect`).

    Null, empty and letterless texts are rejected with distance 1; a very long text is scored whole; null labels aren't trained on,
    and without any label all is rejected; repeated rows and null ids are scored each; ties go
    to the first language by name; an empty table gives no rows; other columns aren't returned.
    """
    model = train(docs, text_col, lang_col, per_language, per_cluster)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = checkpoint(score(slim, model).drop("text"))
    f = if_small(checkpoint(fences(scored, model, spread)))
    out = scored.join(f, (F.col("lang_id") == F.col("lang__f")) & (F.col("size_class") == F.col("size__f")), "left")
    ok = F.coalesce(F.col("distance") <= F.col("fence__f"), F.lit(False))
    return out.select(F.col("id").alias(id_col), F.when(ok, F.col("lang_id")).alias("lang_id"), F.round("distance", 6).alias("distance"), ok.alias("accepted"))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", spread: float = 8.0, per_language: int = 300, per_cluster: int = 4) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` accepts, with the columns they have. Texts aren't shuffled."""
    model = train(docs, text_col, lang_col, per_language, per_cluster)
    names = tuple(fresh(docs, "lang_id", "distance", "size_class"))
    f = if_small(checkpoint(fences(score(docs.select(text_col), model, text_col), model, spread)))
    scored = score(docs, model, text_col, names)
    out = scored.join(f, (scored[names[0]] == f["lang__f"]) & (scored[names[2]] == f["size__f"]))
    return out.filter(scored[names[1]] <= f["fence__f"]).select(*[scored[c] for c in docs.columns])
