"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public split pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces whose counts a worker remembers before it starts afresh.
MEMO = 300_000
#: Characters of the longest piece that is remembered.
LONG_PIECE = 100


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols that remain of a piece: its bytes less the merges made.

    Symbols are nodes of a linked list, adjacent pairs wait in a heap by (rank, place); a popped
    pair is stale, and skipped, unless both its symbols are still as they were when it was pushed.
    No identifier is looked up or emitted.
    """
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        _, i, stop = pop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i] = stop
        end[j] = 0
        merges += 1
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            if r is not None:
                push(heap, (r, i, end[stop]))
        b = before[i]
        if b >= 0:
            r = get(piece[b:stop])
            if r is not None:
                push(heap, (r, b, stop))
    return n - merges


class _Counts(dict):
    """Counts by piece; a missing one is computed."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = merged_length(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= LONG_PIECE:
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) for every row of ``docs``.

    ``vocabulary`` is the path of a rank file that every executor can read. A text is split by
    SPLIT, and each piece merged by :func:`merged_length`; a worker remembers MEMO pieces.

    A null text has a null count, an empty one 0. A very long text is split and merged piece by piece; a long piece takes memory in
    proportion to its bytes, and isn't remembered. Repeated rows and ids are counted each, a null
    id stays null, an empty table gives no rows, and other columns are neither read nor returned.
    No shuffle.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks = load_ranks(vocabulary)
        split = regex.compile(SPLIT).findall
        counts = _Counts(ranks)
        get = counts.__getitem__
        for b in batches:
            out = []
            for t in b.column(1):
                t = t.as_py()
                out.append(None if t is None else sum(map(get, split(t))))
                if len(counts) > MEMO:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["id", "n_tokens"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
