"""Line deduplication: Bloom filters find suspected repeats, and only those are shuffled and compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import checkpoint, fresh, mix, release, span_hashes, text_batches

PROBES = 4
#: Lines of a chunk, which are sent together.
CHUNK_LINES = 2_000_000
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def split_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and numbers within the row of all lines; an empty text has one."""
    nl = np.flatnonzero(data == 10)
    starts = np.concatenate([off[:-1], nl + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, nl, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = off[row + 1].copy()
    if len(row) > 1:
        inner = row[1:] == row[:-1]
        ends[:-1][inner] = starts[1:][inner] - 1
    first = np.searchsorted(row, np.arange(len(off) - 1))
    return starts, ends, row, np.arange(len(row)) - first[row]


def filled_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`split_lines`, with hashes, and only lines with a byte above 32."""
    starts, ends, row, number = split_lines(data, off)
    run = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data > 32, out=run[1:])
    some = run[ends] > run[starts]
    starts, ends, row, number = starts[some], ends[some], row[some], number[some]
    return span_hashes(data, starts, ends), starts, ends, row, number


def _places(keys: np.ndarray, bits: np.ndarray | int) -> list[np.ndarray]:
    k = keys.astype(np.uint64)
    return [(mix(k ^ s) % np.uint64(bits) if np.isscalar(bits) else mix(k ^ s) % bits).astype(np.int64) for s in _SALT[:PROBES]]


class Suspects:
    """The twice-seen filter: one Bloom filter for each segment of the hash space."""

    def __init__(self, segments: int, rows: list[tuple[int, int, bytes]]):
        self.shift = _shift(segments)
        self.bits = np.ones(segments, np.uint64)
        self.base = np.zeros(segments, np.int64)
        self.any = np.zeros(segments, bool)
        parts, at = [], 0
        for seg, m, raw in rows:
            self.bits[seg], self.base[seg], self.any[seg] = m, at * 8, True
            parts.append(raw)
            at += len(raw)
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        return self.test_keys(_key(h, self.shift), (h >> self.shift).astype(np.int64))

    def test_keys(self, keys: np.ndarray, seg: np.ndarray) -> np.ndarray:
        ok = self.any[seg]
        for p in _places(keys, self.bits[seg]):
            p = p + self.base[seg]
            ok &= (self.data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return ok


def _shift(segments: int) -> np.uint64:
    return np.uint64(64 - (segments.bit_length() - 1))


def _key(h: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((h << (np.uint64(64) - shift)) >> np.uint64(32)).astype(np.uint32)


def twice_seen(docs: DataFrame, segments: int, text_col: str = "text", bits_per_key: int = 10) -> DataFrame:
    """(seg, m, bits): for each segment, a Bloom filter of the hashes seen at least twice.

    A task sends, for each segment, the sorted distinct 32-bit keys of its lines, and which of them
    it has seen twice. The segment's owner adds them to a once-seen Bloom filter; a key that is
    already in it goes to the twice-seen filter. False positives only add suspects.
    """
    shift = _shift(segments)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            seg = (h >> shift).astype(np.int32)
            k = _key(h, shift)
            cut = np.searchsorted(seg, np.arange(segments + 1))
            rows = [(s, k[a:b].tobytes(), k[a:b][n[a:b] > 1].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["seg", "once", "twice"])

        for b in batches:
            for _, _, data, off in text_batches(b, "text"):
                held.append(filled_lines(data, off)[0])
                size += len(held[-1])
                if size > CHUNK_LINES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def build(t: pa.Table) -> pa.Table:
        once_keys = [np.frombuffer(x, np.uint32) for x in t["once"].to_pylist()]
        known_twice = [np.frombuffer(x, np.uint32) for x in t["twice"].to_pylist()]
        m = max(64, bits_per_key * sum(map(len, once_keys)))
        once = np.zeros(m, bool)
        found = []
        for k, two in zip(once_keys, known_twice):
            p = _places(k, m)
            seen = np.logical_and.reduce([once[x] for x in p])
            found += [k[seen], two]
            for x in p:
                once[x] = True
        suspect = np.unique(np.concatenate(found))
        m2 = max(64, 14 * len(suspect))
        twice = np.zeros(m2, bool)
        for x in _places(suspect, m2):
            twice[x] = True
        raw = [np.packbits(twice).tobytes()] if len(suspect) else []
        return pa.table({"seg": pa.array([t["seg"][0].as_py()] * len(raw), pa.int32()), "m": pa.array([m2] * len(raw), pa.int64()), "bits": pa.array(raw, pa.binary())})

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(keys, "seg int, once binary, twice binary")
    return sent.groupBy("seg").applyInArrow(build, "seg int, m bigint, bits binary")


def _list_column(row: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of sorted rows as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def _marked_by_broadcast(docs: DataFrame, text_col: str, name: str, suspects) -> DataFrame:
    """``docs`` with the numbers of their suspect lines, tested against the broadcast filter."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = suspects.value
        for b in batches:
            for i, j, data, off in text_batches(b, text_col):
                h, _, _, row, number = filled_lines(data, off)
                hit = s.test(h)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, _list_column(row[hit], j - i, number[hit], pa.int32())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def suspect_numbers(docs: DataFrame, twice: DataFrame, segments: int, id_col: str, text_col: str) -> DataFrame:
    """(id, numbers) of documents with suspect lines, for a filter that is too large for broadcast.

    Keys of lines go to the owner of their segment's filter, with the id and number of the line,
    and those that the filter has come back. What a chunk has more than once is suspect without
    asking, so that of a line that is everywhere a chunk sends one at most.
    """
    shift = _shift(segments)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType
    names = ["seg", "ids", "which", "number", "key"]
    sent = T.StructType([T.StructField("seg", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in names[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size, rows, flushed = [], [], 0, 0, 0

        def flush():
            h, row, number = (np.concatenate(x) for x in zip(*held))
            everyone = pa.concat_arrays(ids)
            order = np.argsort(h, kind="stable")
            new = np.append(True, np.diff(h[order].view(np.int64)) != 0)
            many = np.diff(np.append(np.flatnonzero(new), len(h)))
            again = np.empty(len(h), bool)
            again[order] = np.repeat(many > 1, many)
            place = np.where(again, -1 - flushed % segments, (h >> shift).astype(np.int64))
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            out = []
            for a, z in zip(first, np.append(first[1:], len(place))):
                o = order[a:z]
                who, which = np.unique(row[o], return_inverse=True)
                out.append((int(place[a]), everyone.take(pa.array(who)), which.astype(np.uint32).tobytes(), number[o].astype(np.uint32).tobytes(), _key(h[o], shift).tobytes()))
            at = pa.array(np.cumsum([0, *(len(o[1]) for o in out)]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.ListArray.from_arrays(at, pa.concat_arrays([o[1] for o in out])), *[pa.array([o[k] for o in out], pa.binary()) for k in (2, 3, 4)]], names)

        for b in batches:
            for i, j, data, off in text_batches(b, "text"):
                h, _, _, row, number = filled_lines(data, off)
                held.append((h, row + rows, number))
                ids.append(b.column(0).slice(i, j - i))
                rows += j - i
                size += len(h)
                if size > CHUNK_LINES:
                    yield flush()
                    held, ids, size, rows, flushed = [], [], 0, 0, flushed + 1
        if size:
            yield flush()

    def look(lines: pa.Table, filters: pa.Table) -> pa.Table:
        who, numbers = [], []
        if lines.num_rows:
            own = lines["seg"][0].as_py()
            s = Suspects(1, [(0, m, raw) for m, raw in zip(filters["m"].to_pylist(), filters["bits"].to_pylist())]) if own >= 0 else None
            for ids, which, number, key in zip(lines["ids"], *(lines[c].to_pylist() for c in names[2:])):
                which, number = np.frombuffer(which, np.uint32), np.frombuffer(number, np.uint32)
                if s is not None:
                    hit = s.test_keys(np.frombuffer(key, np.uint32), np.zeros(len(which), np.int64))
                    which, number = which[hit], number[hit]
                order = np.lexsort((number, which))
                who.append(ids.values.take(pa.array(np.unique(which).astype(np.int64))))
                numbers += [x.tolist() for x in np.split(number[order], np.flatnonzero(np.diff(which[order])) + 1) if len(x)]
        out_ids = pa.concat_arrays(who) if who else pa.nulls(0, pa.int64())
        return pa.table({"id": out_ids, "numbers": pa.array(numbers, pa.list_(pa.int32()))})

    out = T.StructType([T.StructField("id", kind), T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    met = slim.mapInArrow(run, sent).groupBy("seg").cogroup(twice.groupBy("seg")).applyInArrow(look, out)
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))


def _marked_by_join(docs: DataFrame, id_col: str, text_col: str, name: str, numbers: DataFrame) -> DataFrame:
    """``docs`` with the numbers of their suspect lines, joined by id; those that a row of the id hasn't drop."""
    (who,) = fresh(docs, "marked_id")
    known = numbers.select(F.col("id").alias(who), F.col("numbers").alias(name))
    joined = docs.join(known, docs[id_col].eqNullSafe(known[who]), "left").drop(who)
    lines = F.size(F.split(F.col(text_col), "\n", -1))
    real = F.filter(F.col(name), lambda i: i < lines)
    return joined.withColumn(name, F.coalesce(real, F.array().cast("array<int>")))


def _lines(slim: DataFrame, suspects=None) -> DataFrame:
    """(id, i, h, line) of the suspect lines of (id, text), by the broadcast filter, or of (id, text, numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = suspects and suspects.value
        for b in batches:
            for i, j, data, off in text_batches(b, "text"):
                h, starts, ends, row, number = filled_lines(data, off)
                hit = s.test(h) if s else _asked(row, number, b.column(2).slice(i, j - i))
                raw = data.tobytes()
                line = pa.array([raw[a:z] for a, z in zip(starts[hit].tolist(), ends[hit].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[hit] + i)), pa.array(number[hit], pa.int32()), pa.array(h[hit].view(np.int64)), line.cast(pa.string())], ["id", "i", "h", "line"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, i int, h bigint, line string")


def _asked(row: np.ndarray, number: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which (row, number) are in the rows' lists."""
    sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
    wanted = (np.repeat(np.arange(len(sizes)), sizes) << 32) + np.array(lists.flatten(), np.int64)
    return np.isin((row << 32) + number, wanted)


def _named(row: np.ndarray, number: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit name of (row, line number, hash)."""
    place = (row.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)
    return mix(mix(place) + h.astype(np.uint64))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64 << 20, segment_bytes: int = 1 << 30, least_segments: int = 16) -> DataFrame:
    """``docs`` with each repeated line left only where it occurs first, by (id, line number).

    Lines are compared exactly, as they are; blank ones (no byte above 32) always stay. Bloom
    filters of once-seen and twice-seen hashes (:func:`twice_seen`) cover segments of the hash
    space, one for about ``segment_bytes`` of text. Twice-seen filters of at most ``broadcast_bytes`` in all go to every task, and texts
    are tested where they are; larger ones stay with the owners of their segments, and keys of
    lines go there (:func:`suspect_numbers`), after which documents are shuffled by id to be marked. Suspects are the same
    either way. Only suspect lines are shuffled, and grouped
    by their text, each sent once by a task; and only documents with one are shuffled to
    drop lines.

    A null text stays null; a text whose lines all go is empty. A null id comes first. Lines of the same text, id and number are
    one occurrence, so that repeated rows are treated alike, and all stay; rows of an id with different
    texts are each judged by their own lines. A very long text is one row like others. An empty
    table gives no rows; other columns are kept as they are.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    segments = 1 << (max(least_segments, size // segment_bytes) - 1).bit_length()
    (name,) = fresh(docs, "suspects")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    twice = checkpoint(twice_seen(docs, segments, text_col))
    total = twice.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    if total <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(Suspects(segments, [(r["seg"], r["m"], bytes(r["bits"])) for r in twice.collect()]))
        mark = lambda d: _marked_by_broadcast(d, text_col, name, shared)
        lines = _lines(slim, shared)
    else:
        numbers = checkpoint(suspect_numbers(docs, twice, segments, id_col, text_col))
        mark = lambda d: _marked_by_join(d, id_col, text_col, name, numbers)
        lines = _lines(_marked_by_join(slim, "id", "text", "numbers", numbers).filter(F.size("numbers") > 0))
    first = lines.groupBy("line").agg(F.min(F.struct("id", "i")).alias("at"), F.min("h").alias("h"))
    keep_name, has = fresh(docs, "kept", "kept_id")
    kept = checkpoint(first.groupBy(F.col("at.id").alias(has)).agg(F.collect_list(F.struct(F.col("at.i").alias("i"), "h")).alias(keep_name)))
    release(spark)

    every = mark(docs)
    clean = every.filter(F.size(name) == 0).drop(name)
    touched = every.filter(F.size(name) > 0)
    joined = touched.join(kept, touched[id_col].eqNullSafe(kept[has]), "left").drop(has)
    columns = docs.columns
    at = columns.index(text_col)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = {c: b.schema.get_field_index(c) for c in (name, keep_name)}
            for i, j, data, off in text_batches(b, text_col):
                part = b.slice(i, j - i)
                h, _, _, row, number = filled_lines(data, off)
                hit = _asked(row, number, part.column(where[name]))
                lists = part.column(where[keep_name])
                kept_lines = lists.flatten()
                owner = np.repeat(np.arange(j - i), np.array(lists.value_lengths().fill_null(0), np.int64))
                stays = _named(owner, np.array(kept_lines.field("i"), np.int64), np.array(kept_lines.field("h"), np.int64))
                hit &= ~np.isin(_named(row, number, h), stays)
                out = part.column(at).to_pylist()
                row, number = row[hit], number[hit]
                for r, numbers_ in zip(row[np.flatnonzero(np.append(True, row[1:] != row[:-1]))].tolist() if len(row) else (), np.split(number, np.flatnonzero(np.diff(row)) + 1)):
                    gone = set(numbers_.tolist())
                    out[r] = "\n".join([x for k, x in enumerate(out[r].split("\n")) if k not in gone])
                cols = list(part.columns[: len(columns)])
                cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, columns)

    return clean.unionByName(joined.mapInArrow(drop, docs.schema))
