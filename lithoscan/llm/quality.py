"""Quality rules with thresholds that follow the data of each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, if_small, span_hashes, text_batches, words

#: Measures, and on which side a value is suspect.
MEASURES = {
    "symbol_share": "high",  # ASCII punctuation among bytes that aren't blank
    "upper_share": "high",  # ASCII capitals among ASCII letters
    "repeat_share": "high",  # words equal to the word before
    "word_bytes": "both",  # mean length of words
    "line_repeat_share": "high",  # lines that occur before in the same text
    "digit_share": "high",  # digits among bytes that aren't blank
}
#: Entries of a quantile sketch: the rank of a quantile is wrong by about 0.3 % at most.
SKETCH = 1024
#: Rows of the wider group that count beside those of a group.
PRIOR_ROWS = 50
#: Rows without any of a share that count beside those of the whole table that have some.
PRIOR_NONE = 10
#: The quantile of weights that a short text is helped by.
SHORT = 0.1
#: Bytes that aren't blank and weigh as much as a word, where a text has more of them than words.
WORD_BYTES = 12

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b in (9, 10, 11, 12, 13, 32) else 1 if _b < 128 and not _c.isalnum() else 2 if "0" <= _c <= "9" else 3 if "A" <= _c <= "Z" else 4 if "a" <= _c <= "z" else 5


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The MEASURES of each text, 0 where there is nothing to measure; and its weight in words."""
    kind = _CLASS[data]
    n = len(off) - 1
    solid, symbols, digits, upper, lower = (_sums(f, off) for f in (kind > 0, kind == 1, kind == 2, kind == 3, kind == 4))
    low, starts, ends, first = words(data, off)
    h = span_hashes(low, starts, ends)
    count = np.diff(first)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][first[:-1] < len(h)]] = False
    nl = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], nl + 1]))
    edges = edges[edges < len(data)]
    stop = np.append(edges[1:], len(data)) if len(edges) else edges
    body = stop - (data[stop - 1] == 10) if len(edges) else edges
    edges, body = edges[body > edges], body[body > edges]
    line = span_hashes(data, edges, body)
    row = np.searchsorted(off, edges, "right") - 1
    again = np.zeros(len(line), np.int64)
    if len(line):
        order = np.lexsort((line, row))
        again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "symbol_share": share(symbols, solid), "upper_share": share(upper, upper + lower), "repeat_share": share(_sums(same, first), np.maximum(count - 1, 0)),
        "word_bytes": share(_sums_of(ends - starts, first), count), "weight": np.maximum(count, solid // WORD_BYTES), "line_repeat_share": share(np.bincount(row, again, n), np.bincount(row, minlength=n)), "digit_share": share(digits, solid),
    }


def _sums_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, lang, source, solid, weight, MEASURES) for every row."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, lang string, source string, solid boolean, weight bigint, " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text_batches(b, "text"):
                m = measure(data, off)
                part = b.slice(i, j - i)
                solid = pa.array(_sums(_CLASS[data] > 0, off) > 0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], solid, pa.array(m["weight"], pa.int64()), *[pa.array(m[k], pa.float64()) for k in MEASURES]],
                    ["id", "lang", "source", "solid", "weight", *MEASURES],
                )

    return slim.mapInArrow(run, schema)


def _read(sketch: Column, q: list[float]) -> Column:
    """Quantiles of a sketch as an array, null if it has seen nothing."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x) for x in q])))


def _settle(own: Column, n: Column, wider: Column, prior: int = PRIOR_ROWS) -> Column:
    """The group's quantiles, drawn towards those of the wider group as if by ``prior`` rows of it."""
    n = n.cast("double")
    both = F.zip_with(own, wider, lambda a, b: (n * a + prior * b) / (n + prior))
    return F.when(own.isNull(), wider).when(wider.isNull(), own).otherwise(both)


def thresholds(measured: DataFrame, spread: float) -> DataFrame:
    """(lang, source, and for each measure its median, low and high fence, and the weight of a short text).

    Each language and source has a quantile sketch of every measure over all its rows; these are merged
    to sketches of languages, and of all. Quartile and median of a group are drawn towards those of its language,
    which are drawn towards those of all (:func:`_settle`), so that a group of few rows doesn't judge itself.
    The high fence stands ``spread`` times the distance from lower quartile to median above the median, and
    the low one as far below the quartile: junk lies above the median, so that the lower half tells how clean text varies.
    Fences of shares come from the rows where they aren't 0, as rows without digits don't say how many digits are many; but those of
    all are drawn towards 0 as if by PRIOR_NONE rows, so that the few rows that have any at all don't judge themselves.
    """
    names = [*MEASURES, "weight"]
    filled = {m: F.when(F.col(m) > 0, F.col(m)) if m.endswith("_share") else F.col(m).cast("double") for m in names}
    own = [F.kll_sketch_agg_double(filled[m], F.lit(SKETCH)).alias(m) for m in names] + [F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(f"{m}__all") for m in MEASURES]
    group = checkpoint(measured.filter("solid").groupBy("lang", "source").agg(*own))
    cols = [*names, *(f"{m}__all" for m in MEASURES)]
    merged = [F.kll_merge_agg_double(c, F.lit(SKETCH)).alias(c) for c in cols]
    language = group.groupBy("lang").agg(*merged)
    whole = language.agg(*merged)
    q = {m: [0.25, 0.5] for m in MEASURES} | {"weight": [SHORT]} | {f"{m}__all": [0.5] for m in MEASURES}

    def read(df: DataFrame, keys: list[str], tail: str) -> DataFrame:
        return df.select(*keys, *[_read(F.col(c), q[c]).alias(c + tail) for c in cols], *[F.kll_sketch_get_n_double(c).alias(f"{c}__n{tail}") for c in cols])

    none = F.array(F.lit(0.0), F.lit(0.0))
    top = read(whole, [], "__w").withColumns({f"{m}__w": _settle(F.col(f"{m}__w"), F.col(f"{m}__n__w"), none, PRIOR_NONE) for m in MEASURES if m.endswith("_share")})
    langs = read(language, ["lang"], "__l").crossJoin(F.broadcast(top))  # one row
    langs = langs.select("lang", *[_settle(F.col(f"{c}__l"), F.col(f"{c}__n__l"), F.col(f"{c}__w")).alias(f"{c}__l") for c in cols])
    both = read(group, ["lang", "source"], "__g").join(langs, "lang")
    settled = both.select("lang", "source", *[_settle(F.col(f"{c}__g"), F.col(f"{c}__n__g"), F.col(f"{c}__l")).alias(c) for c in cols])
    out = [F.col("lang").alias("lang__t"), F.col("source").alias("source__t"), F.col("weight")[0].alias("short__t")]
    for m, side in MEASURES.items():
        a, mid = F.col(m)[0], F.col(m)[1]
        out.append(F.col(f"{m}__all")[0].alias(f"{m}__mid"))
        out.append((mid + spread * (mid - a)).alias(f"{m}__high"))
        if side == "both":
            out.append((a - spread * (mid - a)).alias(f"{m}__low"))
    return settled.select(*out)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = 8.0) -> DataFrame:
    """(id_col, lang, source, MEASURES) of the rows of ``docs`` that pass every rule.

    A rule fails if a measure lies outside its fences for the row's language and source
    (:func:`thresholds`), which the measures are joined with; as a short text says little, a text is judged as if a short text (the
    SHORT quantile of the group's weights) of the group's medians were added to it. Its own weight is its words, or one for every
    WORD_BYTES non-blank bytes if that is more, so that symbols without words count. Measures are taken once, from whole
    texts, and only they are written and joined, never texts. No fence is a constant: all come from the sketches.

    Null, empty and blank texts fail. Null languages and sources form a group each (the empty
    name). Repeated rows and null ids are judged each; a value on a fence passes, and so does any value
    of a measure that is 0 in all rows; a very long text is one row; an empty table
    gives no rows; other columns aren't returned.
    """
    measured = checkpoint(measures(docs, id_col, text_col, lang_col, source_col))
    t = if_small(checkpoint(thresholds(measured, spread)))
    ok = F.col("solid")
    n, k = F.col("weight"), F.col("short__t")
    for m, side in MEASURES.items():
        judged = (F.col(m) * n + F.col(f"{m}__mid") * k) / (n + k)
        ok = ok & F.coalesce(judged <= F.col(f"{m}__high"), F.lit(True))
        if side == "both":
            ok = ok & F.coalesce(judged >= F.col(f"{m}__low"), F.lit(True))
    joined = measured.join(t, (F.col("lang") == F.col("lang__t")) & (F.col("source") == F.col("source__t"))).filter(ok)
    return joined.select(F.col("id").alias(id_col), "lang", "source", *[F.round(m, 6).alias(m) for m in MEASURES])
