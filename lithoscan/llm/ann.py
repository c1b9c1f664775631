"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import checkpoint, if_small


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets in order of estimated success, least expected squared shift first.

    Numbers 1 to 2m stand for a query's 2m slot borders in order of distance; their expected
    squared distances are known in closed form for uniform offsets. The sets are made by a heap
    that shifts or extends the last number; one that moves a coordinate both ways is skipped.
    The first set is empty: the query's own bucket.
    """
    m = functions
    low = [j * (j + 1) / (4.0 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    high = [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4.0 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    z = [0.0, *low, *high]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[1], (1,))]
    while heap and len(out) < probes:
        _, a = heapq.heappop(heap)
        if all(2 * m + 1 - j not in a for j in a):
            out.append(a)
        if a[-1] < 2 * m:
            for b in ((*a[:-1], a[-1] + 1), (*a, a[-1] + 1)):
                heapq.heappush(heap, (sum(z[j] for j in b), b))
    return out


class Hashes:
    """``tables`` tables of ``functions`` p-stable functions floor((a.x + b) / width)."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, coarse: int = 1, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width, self.coarse = tables, functions, width, coarse
        self.a = rng.standard_normal((tables, dim, functions)).astype(np.float32)
        self.b = rng.uniform(0, width, (tables, functions)).astype(np.float32)
        self.mult = rng.integers(1, 2**62, functions, dtype=np.int64) * 2 + 1
        self.sets = probe_order(functions, probes)

    def keys(self, slots: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """The part, from the first ``coarse`` functions, and the bucket, from all."""
        part = (slots[..., : self.coarse] * self.mult[: self.coarse]).sum(-1) * np.int64(1_000_003) + table
        return part, (slots * self.mult).sum(-1)

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.floor(self.place(x, table)).astype(np.int64)

    def place(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def probe_slots(self, x: np.ndarray, table: int) -> np.ndarray:
        """Slots of each row's buckets to visit: (rows, probes, functions)."""
        p = self.place(x, table)
        slot = np.floor(p).astype(np.int64)
        frac = p - slot
        m = self.functions
        border = np.argsort(np.concatenate([frac, 1 - frac], axis=1), axis=1, kind="stable")
        out = np.repeat(slot[:, None, :], len(self.sets), axis=1)
        rows = np.arange(len(x))
        for k, s in enumerate(self.sets):
            for j in s:
                f = border[:, j - 1]
                out[rows, k, f % m] += np.where(f < m, -1, 1)
        return out

    def ranks(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each of ``q``, and each row of ``x`` (of all, or of its own if ``x`` has three axes), the first probe that meets it in any table."""
        out = np.full((len(q), x.shape[-2]), len(self.sets), np.int32)
        for t in range(self.tables):
            probe = self.keys(self.probe_slots(q, t), t)[1]
            mine = self.keys(self.slots(x.reshape(-1, x.shape[-1]), t), t)[1].reshape(x.shape[:-1])
            for r in range(len(q)):
                names, first = np.unique(probe[r], return_index=True)
                row = mine if x.ndim == 2 else mine[r]
                at = np.minimum(np.searchsorted(names, row), len(names) - 1)
                out[r] = np.minimum(out[r], np.where(names[at] == row, first[at], len(self.sets)))
        return out


def fit(queries: np.ndarray, near: np.ndarray, sample: np.ndarray, length: float, recall: float) -> dict:
    """The functions, slot width, tables and probes that meet the least of ``sample`` while they meet
    a share ``recall`` of ``near``, the true neighbours (queries, k, dim) of pilot queries."""
    best, dim = None, sample.shape[1]
    for tables in (2, 4, 8) if recall <= 1 else ():
        for functions in (4, 6, 8, 12, 16, 24):
            for width in (0.5, 1.0, 1.5, 2.2, 3.0, 4.5):
                h = Hashes(dim, tables, functions, width * length, 200)
                at = np.sort(h.ranks(queries, near).ravel())
                needed = int(at[min(len(at) - 1, int(math.ceil(recall * len(at))) - 1)])
                if needed >= len(h.sets):
                    continue
                share = float((h.ranks(queries, sample) <= needed).mean())
                if best is None or share < 0.95 * best["share"]:
                    best = {"share": share, "functions": functions, "tables": tables, "width": width * length, "probes": needed + 1}
    # where nothing is that good, all rows meet
    return best or {"share": 1.0, "functions": 1, "tables": 1, "width": 1e6 * length, "probes": 1}


def _search(ids: np.ndarray, vecs: np.ndarray, bucket: np.ndarray, q_ids: np.ndarray, q_vecs: np.ndarray, q_of: np.ndarray, q_bucket: np.ndarray, k: int):
    """For each query the k nearest members of the buckets it visits, by (distance, id): (query row, member row, distance).

    |q|^2 + |x|^2 - 2 q.x only rules out members that are farther than the k-th by more than its
    rounding error; the others' differences are measured. Of an id with several vectors the nearest counts.
    """
    vecs, q_vecs = vecs.astype(np.float64), q_vecs.astype(np.float64)
    order = np.argsort(bucket, kind="stable")
    names, start = np.unique(bucket[order], return_index=True)
    stop = np.append(start[1:], len(order))
    q_order = np.argsort(q_bucket, kind="stable")
    sorted_q = q_bucket[q_order]
    lo, hi = np.searchsorted(sorted_q, names), np.searchsorted(sorted_q, names, "right")
    best_d = np.full((len(q_ids), k), np.inf)
    best_i = np.full((len(q_ids), k), -1, np.int64)
    norm, q_norm = (vecs**2).sum(1), (q_vecs**2).sum(1)
    enough = k * int(np.unique(ids, return_counts=True)[1].max())  # so many members have k ids at least
    slack = (vecs.shape[1] + 16) * 2.0**-51
    for s, e, a, z in zip(start, stop, lo, hi):
        for a2 in range(a, z, 1024):
            q = q_of[q_order[a2 : min(z, a2 + 1024)]]
            for s2 in range(s, e, 1024):
                m = order[s2 : min(e, s2 + 1024)]
                d = q_norm[q][:, None] + norm[m][None] - 2 * (q_vecs[q] @ vecs[m].T)
                d[q_ids[q][:, None] == ids[m][None]] = np.inf
                error = slack * (q_norm[q] + norm[m].max())
                far = best_d[q, -1] ** 2 + error
                near = d <= far[:, None]
                if len(m) > enough and near.sum() > 4 * enough * len(q):
                    near &= d <= (np.partition(d, enough - 1, axis=1)[:, enough - 1] + error)[:, None]
                near &= np.isfinite(d)
                row, col = np.nonzero(near)
                if not len(row):
                    continue
                member = m[col]
                exact = np.concatenate([np.sqrt(((q_vecs[q[row[i : i + 65536]]] - vecs[member[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)])
                old_row, old_col = np.nonzero(best_i[q] >= 0)
                row, member, exact = np.append(row, old_row), np.append(member, best_i[q[old_row], old_col]), np.append(exact, best_d[q[old_row], old_col])
                if enough > k:
                    by = np.lexsort((exact, ids[member], row))
                    first = np.append(True, (np.diff(row[by]) != 0) | (np.diff(ids[member[by]]) != 0))
                    row, member, exact = row[by][first], member[by][first], exact[by][first]
                by = np.lexsort((ids[member], exact, row))
                row, member, exact = row[by], member[by], exact[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < k
                best_d[q[row[top]], rank[top]], best_i[q[row[top]], rank[top]] = exact[top], member[top]
    row, col = np.nonzero(best_i >= 0)
    return row, best_i[row, col], best_d[row, col]


def _mean(rows: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean over all vectors of ``of``, which gives a row for each; one sum of each task goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = of(np.array(b.column(0).flatten(), np.float64).reshape(b.num_rows, dim)).sum(0)
                n, total = n + b.num_rows, x if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    got = rows.select("v").mapInArrow(run, "n bigint, s array<double>").collect()
    return np.sum([r["s"] for r in got], axis=0) / sum(r["n"] for r in got)


def _pilot(rows: DataFrame, centre: np.ndarray, dim: int, k: int, pilots: int, sampled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pilot queries, their true k nearest over the whole table, and a sample of rows (all centred): bounded, chosen by a hash of the id."""
    rows = rows.withColumn("h", F.xxhash64("id", F.lit(29)))
    got = rows.orderBy("h", "id").limit(pilots + sampled).collect()
    take = np.array([r["v"] for r in got], np.float64).reshape(-1, dim)
    q, ids = take[:pilots], np.array([r["id"] for r in got[:pilots]], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_v = np.full((len(q), k), np.inf), np.zeros((len(q), k, dim))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, dim)
                d = ((q - centre) ** 2).sum(1)[:, None] + ((x - centre) ** 2).sum(1)[None] - 2 * ((q - centre) @ (x - centre).T)
                d[ids[:, None] == np.array(b.column(0))[None]] = np.inf
                m = min(k, d.shape[1])
                top = np.argpartition(d, m - 1, axis=1)[:, :m] if d.shape[1] > m else np.tile(np.arange(m), (len(q), 1))
                all_d = np.concatenate([best_d, np.take_along_axis(d, top, 1)], axis=1)
                all_v = np.concatenate([best_v, x[top]], axis=1)
                keep = np.argsort(all_d, axis=1)[:, :k]
                best_d, best_v = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_v, keep[:, :, None], 1)
        r, c = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(best_d[r, c]), pa.array(list(best_v[r, c]), pa.list_(pa.float64()))], ["q", "d", "v"])

    found = rows.select("id", "v").mapInArrow(run, "q bigint, d double, v array<double>")
    top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v"))), 1, k).alias("t")).collect()
    near = [[x["v"] for x in r["t"]] for r in top if len(r["t"]) == k]
    used = [r["q"] for r in top if len(r["t"]) == k]
    return (q[used] - centre).astype(np.float32), (np.array(near).reshape(-1, k, dim) - centre).astype(np.float32), (take - centre).astype(np.float32)


def nearest(
    vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", asking: Column | None = None, recall: float = 0.96,
    part_rows: int = 8192, pilots: int = 64, sampled: int = 2048,
) -> DataFrame:
    """(query_id, neighbour_id, rank, distance): for every query its ``k`` nearest rows by Euclidean distance.

    Queries are the rows of ``vectors`` that meet the condition ``asking`` (default: all); each is held against all rows.
    Several tables cut the space by p-stable projections into slots. A query visits its own bucket and perturbed ones of every
    table, in the order of :func:`probe_order`; members met are ranked by exact distance, and the
    tables' candidates are merged. No bucket is cut short, and
    a list of candidates only behind its k nearest by exact distance and id.

    Numbers of functions, tables and probes and the width of slots are fitted (:func:`fit`): among those that find a share
    ``recall`` of the true neighbours of ``pilots`` rows (their neighbours are searched in the whole table), the one that meets the
    fewest of ``sampled`` rows. Every row is indexed.

    Rows meet by (table, slots of the first functions), as many functions as a part of about ``part_rows`` rows takes; a larger
    part is cut into blocks of so many rows, each of which gets the queries that visit it, with their buckets there.

    Rows of the same id aren't neighbours of each other; repeated rows are one. Ties go to the
    lesser id. Rows with a null id, or a vector that is null, empty, of another length than the
    commonest (the longer, if two are), or with a null or non-finite element, neither search nor are found. An empty table
    gives no rows; other columns aren't read.
    """
    vec = F.col(vec_col).cast("array<float>")
    ask = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("v"), ask.alias("asks")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, neighbour_id bigint, rank int, distance double")
    dim, n = dims["dim"], dims["n"]
    rows = rows.filter(F.size("v") == dim)
    centre = _mean(rows, dim, lambda x: x)
    length = float(_mean(rows, dim, lambda x: np.linalg.norm(x - centre, axis=1, keepdims=True))[0]) or 1.0
    pilot_q, near, sample = _pilot(rows, centre, dim, k, pilots, sampled)
    # where neighbours are a large part of the table, all rows meet
    found = fit(pilot_q, near, sample, length, recall if n > 20 * k and len(pilot_q) else 2.0)
    hashes = Hashes(dim, found["tables"], found["functions"], found["width"], found["probes"])
    for c in range(1, hashes.functions + 1):
        hashes.coarse = c
        if len(sample) and np.unique(hashes.keys(hashes.slots(sample, 0), 0)[0], return_counts=True)[1].max() * n <= part_rows * len(sample):
            break
    once = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    tables = hashes.tables
    sent = T.StructType([T.StructField("part", T.LongType()), T.StructField("query", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("buckets", T.BinaryType())])

    def vectors_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(b.column(b.schema.get_field_index("v")).flatten(), np.float32).reshape(b.num_rows, dim)
        return x, (x - centre).astype(np.float32)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            if b.num_rows:
                x = vectors_of(b)[1]
                for t in range(tables):
                    for part, c in zip(*np.unique(hashes.keys(hashes.slots(x, t), t)[0], return_counts=True)):
                        total[int(part)] = total.get(int(part), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["part", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids = b.column(0)
                x, near_0 = vectors_of(b)
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                asks = np.flatnonzero(np.array(b.column(2), bool))
                for t in range(tables):
                    part, bucket = hashes.keys(hashes.slots(near_0, t), t)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(x), bool)), ids, raw, pa.array([key.tobytes() for key in bucket], pa.binary())], sent.names)
                    if not len(asks):
                        continue
                    part, bucket = hashes.keys(hashes.probe_slots(near_0[asks], t), t)
                    row = np.repeat(np.arange(len(asks)), bucket.shape[1])
                    part, bucket = part.ravel(), bucket.ravel()
                    order = np.lexsort((bucket, part, row))
                    row, part, bucket = row[order], part[order], bucket[order]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
                    stop = np.append(first[1:], len(row))
                    who = pa.array(asks[row[first]])
                    yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.ones(len(first), bool)), ids.take(who), raw.take(who), pa.array([bucket[a:z].tobytes() for a, z in zip(first, stop)], pa.binary())], sent.names)

    def meet(t: pa.Table) -> pa.Table:
        q = np.array(t["query"])
        ids = np.array(t["id"])
        vecs = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(-1, dim)
        keys = [np.frombuffer(x, np.int64) for x in t["buckets"].to_pylist()]
        inside, asks = np.flatnonzero(~q), np.flatnonzero(q)
        if not len(inside) or not len(asks):
            return pa.table({"query_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        bucket = np.concatenate([keys[i] for i in inside])
        q_bucket = np.concatenate([np.unique(keys[i]) for i in asks])
        q_of = np.repeat(np.arange(len(asks)), [len(np.unique(keys[i])) for i in asks])
        row, member, d = _search(ids[inside], vecs[inside], bucket, ids[asks], vecs[asks], q_of, q_bucket, k)
        return pa.table({"query_id": ids[asks][row], "neighbour_id": ids[inside][member], "distance": d})

    parts = once.select("v").mapInArrow(sizes, "part bigint, n bigint").groupBy(F.col("part").alias("of")).agg(F.ceil(F.sum("n") / part_rows).cast("int").alias("blocks"))
    parts = if_small(checkpoint(parts))
    placed = once.select("id", "v", "asks").mapInArrow(send, sent).join(parts, F.col("part") == F.col("of"))  # a part without rows has none to find
    block = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    met = placed.withColumn("block", F.explode(block)).groupBy("part", "block").applyInArrow(meet, "query_id bigint, neighbour_id bigint, distance double")
    best = met.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    top = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("t"))
    return top.select("query_id", F.posexplode("t").alias("r", "x")).select("query_id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("r") + 1).cast("int").alias("rank"), F.round("x.distance", 6).alias("distance"))
