"""Packing documents into fixed windows by non-negative least squares.

A document's tokens (its ids and one end id) are cut into full windows and a remainder
shorter than a window.  The remainders' lengths form a histogram with fewer bins than
the window has tokens.  All ways to fill a window exactly with two or three of these
lengths are enumerated; non-negative least squares finds how often to repeat each so
that the histogram is used up; the counts are rounded down and raised again while pieces
last.  What is left is packed greedily end to end and cut where a window is full; its
last, partial window is split into powers of two, which need no padding.

Only the histogram and the plan made from it reach the driver; both are bounded by the
window, whatever the number of documents.  Within a length, documents are numbered
through salted groups, so a length that a third of all documents share is no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_pairs
from .common import Stash

#: Rows that one salted group numbers, about.
GROUP_ROWS = 50_000
#: Bytes of ids after which the pieces made so far are handed on.
BATCH_BYTES = 8 << 20


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, of present lengths that sum to the window; a is 0 for pairs."""
    present = np.flatnonzero(histogram)
    there = np.zeros(window + 1, bool)
    there[present] = True
    rows = []
    for a in [0, *present[present <= window // 3]]:
        b = present[(present >= a) & (2 * present <= window - a)]
        c = window - a - b
        keep = there[c] & (c >= b)
        rows.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(rows).astype(np.int64)


def non_negative(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient.

    Column j of A counts the lengths of combination j; entry 0 of the histogram is ignored.
    """
    size = len(histogram)
    goal = histogram.astype(np.float64).copy()
    goal[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    probe = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        grown = used(probe)[combos].sum(1)
        step = np.linalg.norm(grown)
        probe = grown / step
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        rest = used(y) - goal
        new = np.maximum(0, y - rest[combos].sum(1) / (1.02 * step))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def repeats(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram allows: rounded down, then raised while pieces last."""
    left = histogram.astype(np.int64).tolist()
    out = [0] * len(combos)
    order = np.argsort(-x, kind="stable").tolist()
    most = np.floor(x + 1e-9).astype(np.int64).tolist()
    parts = [[v for v in row if v] for row in combos.tolist()]
    for limited in (True, False):
        for j in order:
            n = most[j] if limited else 1 << 62
            for v in set(parts[j]):
                n = min(n, left[v] // parts[j].count(v))
            if n > 0:
                out[j] += n
                for v in parts[j]:
                    left[v] -= n
    return np.array(out, np.int64)


class Plan:
    """Where the piece of rank r among the remainders of a length goes; bounded by the window."""

    def __init__(self, histogram: np.ndarray, window: int, first: int):
        """``first``: the first free sequence id, above those of the full windows."""
        combos = combinations(histogram, window)
        times = repeats(combos, non_negative(combos, histogram), histogram) if len(combos) else np.zeros(0, np.int64)
        self.window, self.starts, self.slots = window, {}, {}
        rank = np.zeros(window + 1, np.int64)
        sequence = first
        for row, n in zip(combos[times > 0].tolist(), times[times > 0].tolist(), strict=True):
            offset = 0
            for v in row:
                if v:
                    self.starts.setdefault(v, []).append(int(rank[v]))
                    self.slots.setdefault(v, []).append((sequence, offset))
                    rank[v] += n
                    offset += v
            sequence += n
        self.used = rank
        lengths = np.arange(window + 1)
        rest = (np.append(histogram, 0)[: window + 1] - rank) * lengths
        self.greedy_at = np.cumsum(rest) - rest
        self.greedy_first = sequence
        self.full = int(rest.sum()) // window
        tail, at, self.tail = int(rest.sum()) % window, 0, []
        for bit in range(window.bit_length(), -1, -1):
            if tail >> bit & 1:
                self.tail.append(at)
                at += 1 << bit
        self.starts = {v: np.array(s, np.int64) for v, s in self.starts.items()}

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            k = int(np.searchsorted(self.starts[length], rank, "right")) - 1
            sequence, offset = self.slots[length][k]
            return [(0, length, sequence + rank - int(self.starts[length][k]), offset)]
        at = int(self.greedy_at[length]) + (rank - int(self.used[length])) * length
        out, done = [], 0
        while done < length:
            where = at + done
            if where < self.full * self.window:
                sequence, offset = divmod(where, self.window)
                room = self.window - offset
            else:
                where -= self.full * self.window
                k = int(np.searchsorted(self.tail, where, "right")) - 1
                sequence, offset = self.full + k, where - self.tail[k]
                room = (self.tail[k + 1] if k + 1 < len(self.tail) else 1 << 62) - where
            take = min(room, length - done)
            out.append((done, take, self.greedy_first + sequence, offset))
            done += take
        return out


def encoded(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: tokens, all their ids (of two bytes each where the vocabulary allows it), and ``turn``.

    ``turn`` is the row's number in its task; equal rows differ in it, so that they are
    numbered in many groups.  It is stored with the row: what is read later agrees.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = byte_pairs(path), 0
        kind = "<u4" if max(len(pairs.sizes) - 1, end_id) >= 1 << 16 else "<u2"
        for batch in batches:
            tokens, every = [], []
            turn, seen = pa.array(range(seen, seen + len(batch)), pa.int64()), seen + len(batch)
            for cell in batch.column(1):
                ids = np.append(pairs.ids(cell.as_py() or ""), np.uint32(end_id)).astype(kind)
                tokens.append(len(ids))
                every.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(every, pa.binary()), turn], ["id", "tokens", "ids", "turn"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"id {kind}, tokens long, ids binary, turn long")


def numbered(rows: DataFrame, window: int, groups: int) -> DataFrame:
    """``rows`` with ``rank`` within their remainder's length and ``before``: full windows of earlier rows."""
    rows = rows.withColumns({"length": F.col("tokens") % window, "full": F.floor(F.col("tokens") / window)})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.crc32("ids"), "turn"), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("f"))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"rank0": F.coalesce(F.sum("n").over(by_salt), F.lit(0)), "full0": F.coalesce(F.sum("f").over(by_salt), F.lit(0))}).drop("n", "f")
    own = Window.partitionBy("length", "salt").orderBy("id", "tokens", "ids", "turn")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"r": F.row_number().over(own) - 1, "b": F.coalesce(F.sum("full").over(earlier), F.lit(0))})
    return rows.join(sizes, ["length", "salt"]).withColumns({"rank": F.col("rank0") + F.col("r"), "before": F.col("full0") + F.col("b")})


def pack(docs: DataFrame, path: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` (little-endian uint32) are the ids of the piece, so that the pieces of a sequence,
    by ``offset``, are its content; ``ids_crc32`` is their CRC-32.  Null and empty texts are
    one end id; a text of any length is encoded whole.  Repeated rows are packed each on its
    own, also those without an id, whose pieces have a null id; an empty table gives no
    pieces; further columns are not read.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    rows = stash.save(encoded(docs, path, window, end_id, id_col, text_col), "encoded")
    lengths = rows.groupBy((F.col("tokens") % window).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / window)).alias("f")).collect()
    histogram = np.zeros(window, np.int64)
    for row in lengths:
        histogram[row["length"]] = row["n"]
    full_windows = sum(row["f"] for row in lengths)
    # Numbers of full windows run over lengths first, then over the rows of a length.
    full_first, at = np.zeros(window, np.int64), 0
    for row in sorted(lengths, key=lambda x: x["length"]):
        full_first[row["length"]], at = at, at + row["f"]
    none, histogram[0] = int(histogram[0]), 0
    plan = spark.sparkContext.broadcast((Plan(histogram, window, full_windows), full_first))
    groups = max(64, -(-(int(histogram.sum()) + none) // GROUP_ROWS))
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = plan.value
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def record(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            out, held, of_id = [], 0, batch.schema.field("id").type
            columns = [batch.column(c) for c in ("id", "tokens", "length", "before", "rank", "ids")]
            for cells in zip(*columns, strict=True):
                doc, tokens, length, before, rank, stored = (c.as_py() for c in cells)
                ids = np.frombuffer(stored, f"<u{len(stored) // tokens}").astype("<u4")
                sequence, places = int(first[length]) + before, []
                for k in range(tokens // window):
                    places.append((k * window, window, sequence + k, 0))
                if length:
                    places += ((tokens - length + start, size, at, offset) for start, size, at, offset in made.place(length, rank))
                for start, size, at, offset in places:
                    own = ids[start : start + size].tobytes()
                    out.append((doc, start, size, zlib.crc32(own), tokens, at, offset, own))
                    held += len(own)
                    if held > BATCH_BYTES:
                        yield record(out, of_id)
                        out, held = [], 0
            yield record(out, of_id)

    rows = numbered(rows, window, groups).select("id", "tokens", "ids", "length", "rank", "before")
    return rows.mapInArrow(pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id_col)
