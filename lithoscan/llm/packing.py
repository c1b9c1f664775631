"""Best-fit packing improved by swap-based local search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint

#: Tasks that shards are spread over at most; each then packs several shards, one by one.
MAX_TASKS = 4096


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indexes into ``sizes`` (each from 1 to ``capacity``)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r tokens of room
    for i in order:
        s = sizes[i]
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        r -= s
        if r:
            room[r].append(b)
            mask |= 1 << r
    return bins


class _Holdings:
    """Sums of ``k`` sizes that a bin holds, each once, as rows (total, bin, first size, second size); a changed bin's old rows are dead."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((64, 4), np.int64)
        self.stamp = np.zeros(64, np.int64)
        self.n = 0

    def sums(self, held: dict[int, list[int]]) -> list[tuple[int, int, int]]:
        """(total, first, second) of a bin that holds documents by size."""
        if self.k == 1:
            return [(s, s, 0) for s in held]
        of = sorted(held)
        out = {}
        for x, a in enumerate(of):
            if len(held[a]) > 1:
                out[2 * a] = (2 * a, a, a)
            for b in of[:x]:
                out[a + b] = (a + b, a, b)
        return list(out.values())

    def add(self, b: int, held: dict[int, list[int]], stamps: np.ndarray) -> None:
        new = self.sums(held)
        if self.n + len(new) > len(self.rows):
            live = np.flatnonzero(self.stamp[: self.n] == stamps[self.rows[: self.n, 1]])
            size = max(64, 2 * (len(live) + len(new)))
            rows, stamp = np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
            rows[: len(live)], stamp[: len(live)] = self.rows[live], self.stamp[live]
            self.rows, self.stamp, self.n = rows, stamp, len(live)
        if new:
            at = slice(self.n, self.n + len(new))
            self.rows[at] = [(t, b, x, y) for t, x, y in new]
            self.stamp[at] = stamps[b]
            self.n += len(new)


class LocalSearch:
    """Exchanges between underfull bins, each of which makes the sum of squared fills grow.

    Tokens only go from the emptier of two bins to the fuller, by a move of a document, an
    exchange of one for one, of two for one, or of one for two. Documents of a bin are told apart by
    size only, so that many small ones cost no more than a few.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int, underfull: float):
        self.sizes, self.capacity = sizes, capacity
        full = [sum(sizes[i] for i in b) for b in bins]
        self.done = [b for b, f in zip(bins, full) if f >= underfull * capacity]
        self.bins: list[dict[int, list[int]]] = []
        for b, f in zip(bins, full):
            if f < underfull * capacity:
                held: dict[int, list[int]] = {}
                for i in b:
                    held.setdefault(sizes[i], []).append(i)
                self.bins.append(held)
        self.fill = np.array([f for f in full if f < underfull * capacity], np.int64)
        self.stamps = np.zeros(len(self.bins), np.int64)
        self.one, self.two = _Holdings(1), _Holdings(2)
        for b, held in enumerate(self.bins):
            self.one.add(b, held, self.stamps)
            self.two.add(b, held, self.stamps)

    def target(self, give: int, source: int, held: _Holdings) -> tuple[int, list[int]] | None:
        """Where ``give`` tokens bring most: the bin, and the sizes that it returns (less than it gets)."""
        rows = held.rows[: held.n]
        fill = self.fill[rows[:, 1]]
        gain = give - rows[:, 0]
        fits = (gain > 0) & (fill + gain <= self.capacity) & (fill >= self.fill[source] - gain) & (rows[:, 1] != source)
        fits &= held.stamp[: held.n] == self.stamps[rows[:, 1]]
        at = np.flatnonzero(fits)
        if not len(at):
            return None
        grown = gain[at] * (fill[at] - self.fill[source] + gain[at])  # half the growth of squared fill
        k = int(np.argmax(grown))
        return (int(rows[at[k], 1]), [int(x) for x in rows[at[k], 2:] if x]) if grown[k] > 0 else None

    def move(self, size: int, source: int) -> int | None:
        fits = (self.fill + size <= self.capacity) & (self.fill > 0) & (self.fill > self.fill[source] - size)  # else squared fill doesn't grow
        fits[source] = False
        return int(np.argmax(np.where(fits, self.fill, -1))) if fits.any() else None

    def apply(self, source: int, give: list[int], to: int, back: list[int]) -> None:
        for sizes, a, b in ((give, source, to), (back, to, source)):
            for s in sizes:
                self.bins[b].setdefault(s, []).append(self.bins[a][s].pop())
                if not self.bins[a][s]:
                    del self.bins[a][s]
        gain = sum(give) - sum(back)
        self.fill[source] -= gain
        self.fill[to] += gain
        self.stamps[[source, to]] += 1
        for b in (source, to):
            self.one.add(b, self.bins[b], self.stamps)
            self.two.add(b, self.bins[b], self.stamps)

    def improve(self, source: int) -> bool:
        sizes = sorted(self.bins[source], reverse=True)
        for s in sizes:
            if (to := self.move(s, source)) is not None:
                self.apply(source, [s], to, [])
                return True
        for s in sizes:
            for held in (self.one, self.two):
                if found := self.target(s, source, held):
                    self.apply(source, [s], *found)
                    return True
        for _, a, b in sorted(self.two.sums(self.bins[source]), reverse=True):
            if found := self.target(a + b, source, self.one):
                self.apply(source, [a, b], *found)
                return True
        return False

    def run(self) -> list[list[int]]:
        """Bins, none of them empty."""
        changed = True
        while changed:
            changed = False
            for source in np.argsort(self.fill, kind="stable").tolist():
                live = self.fill[self.fill > 0]
                if len(live) <= -(-int(live.sum()) // self.capacity):
                    changed = False
                    break  # as few bins as can be
                while self.bins[source] and self.improve(source):
                    changed = True
        return self.done + [[i for s in b for i in b[s]] for b in self.bins if b]


def pack_sizes(sizes: list[int], capacity: int, underfull: float = 0.98) -> list[list[int]]:
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity, underfull).run()


def word_count(text: str | Column) -> Column:
    """Runs of anything but white space; null for null."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def pack(
    docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", length: Column | None = None,
    shard_rows: int = 20_000, underfull: float = 0.98,
) -> DataFrame:
    """(id_col, piece, n_tokens, bin_id, bin_tokens) for every piece of every row of ``docs``.

    A document of more than ``capacity`` tokens is cut into full pieces, each a bin of its own,
    and a rest. Rests are spread by a hash of the id over shards of about ``shard_rows``, as many
    as the table needs; each shard is packed by best-fit decreasing and improved by
    :class:`LocalSearch` among bins filled below ``underfull``, until no exchange helps or the
    bins are as few as can be. Only ids and lengths are shuffled.

    ``length`` is a column expression of tokens (default: words of ``text``). A document whose
    length is null or 0 has one row with 0 tokens and a null bin. Repeated rows are each packed,
    null ids too: rows of one id and length are counted before they are shuffled, and many of them spread over
    shards. Ties go by id; an empty table gives no rows; other columns aren't read. A very long
    text gives as many rows as it fills bins.
    """
    n = word_count("text") if length is None else length
    slim = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(n.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    slim = checkpoint(slim.groupBy("id", "n").agg(F.count("*").alias("rows")))
    shards = max(1, -(-slim.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] // shard_rows))
    kind = slim.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("id", "ascending")])
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), np.array(t["rows"], np.int64))))
        ids, ns, shard = t["id"], t["n"].to_pylist(), t["shard"][0].as_py() if t.num_rows else 0
        row, piece, size, bin_id, fill = [], [], [], [], []
        rest, owner, nth, bins = [], [], [], 0
        for i, n in enumerate(ns):
            whole, r = divmod(n, capacity)
            for k in range(whole):
                row.append(i), piece.append(k), size.append(capacity), bin_id.append(bins), fill.append(capacity)
                bins += 1
            if r:
                rest.append(r), owner.append(i), nth.append(whole)
            elif not n:
                row.append(i), piece.append(0), size.append(0), bin_id.append(None), fill.append(None)
        for b in pack_sizes(rest, capacity, underfull):
            f = sum(rest[i] for i in b)
            for i in b:
                row.append(owner[i]), piece.append(nth[i]), size.append(rest[i]), bin_id.append(bins), fill.append(f)
            bins += 1
        bin_id = [None if b is None else (shard << 32) + b for b in bin_id]
        return pa.table({
            "id": ids.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(size, pa.int64()),
            "bin_id": pa.array(bin_id, pa.int64()), "bin_tokens": pa.array(fill, pa.int64()),
        })

    # rows of one id and length go in lots, each to a shard of its own
    lot = max(1, shard_rows // 16)
    lots = slim.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {lot}"))))
    lots = lots.withColumn("rows", F.least(F.lit(lot), F.col("rows") - F.col("lot") * lot)).withColumn("shard", F.pmod(F.xxhash64("id", "n", "lot"), F.lit(shards)))
    # a number of partitions is given, as adaptive planning would join small ones, and packing takes time for few bytes
    sharded = lots.select("id", "n", "rows", "shard").repartition(min(shards, MAX_TASKS), "shard")
    out = sharded.groupBy("shard").applyInArrow(run, f"id {kind}, piece int, n_tokens bigint, bin_id bigint, bin_tokens bigint")
    return out.withColumnRenamed("id", id_col)
