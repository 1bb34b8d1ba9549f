"""LM scoring: cross-entropy difference of a target and a background n-gram model.

Both are bigram models smoothed by unigrams, matched in order, smoothing and vocabulary:
words (A-Z in lower case) and word pairs, told apart by 64-bit hashes.  The background is counted over all documents, the target over those of good
quality; the background's counts are scaled to the target's number of tokens, the
expectation over samples of that size, so that smoothing weighs alike in both.  A
document's own words are taken out of the counts that it is scored with.  Its score is the mean loss per token under the target model minus that
under the background model; the lower, the closer it is to the target.

There is a count for every distinct word and pair.  Documents are boxed into
blocks where they lie, each a compressed row of a stored table; a block sends its distinct
hashes, sorted and with its counts, to buckets that each hold a range of all hashes.  A bucket
adds up what all blocks sent, its share of a table that grows with the corpus, and answers
each block with the sums of the hashes that it sent.  The block scores its documents with
them.  No table is held in one place, and texts are moved once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, checked_broadcast
from .shingles import mixed, word_hashes

#: The least size of the vocabulary that smoothing assumes.
WORDS = 1 << 19
#: Bytes of text of a block and for a bucket, about; the least number of buckets, a task adds
#: up about twice as many.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 8 << 20, 8 << 20, 16
#: Prior count of a word class, and of a context.
FLOOR, PRIOR = 0.5, 8.0


def hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and of every pair of neighbours."""
    words = word_hashes(text or "")
    return words, mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def without_own(table: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Counts of a document's classes in both models, less the document's own share."""
    _, place, n = np.unique(at, return_inverse=True, return_counts=True)
    return np.maximum(table[:, at] - weight[:, None] * n[place], 0)


def losses(words: np.ndarray, pairs: np.ndarray, table: np.ndarray, totals: np.ndarray, weight: np.ndarray, types: int) -> np.ndarray | None:
    """Mean loss per token under the models whose counts are the rows of ``table``.

    ``words`` and ``pairs``: columns of ``table``; ``weight``: what an occurrence in this
    document added to each model's counts; ``types``: the number of words there are.
    """
    if not len(words):
        return None
    own = without_own(table, words, weight)
    alone = (own + FLOOR) / (totals - weight * len(words) + FLOOR * types)[:, None]
    p = alone.copy()
    p[:, 1:] = (without_own(table, pairs, weight) + PRIOR * alone[:, 1:]) / (own[:, :-1] + PRIOR)
    return -np.log(p).mean(1)


def columns(found: list[np.ndarray | None], sizes: list[int]) -> dict[str, pa.Array]:
    """The result's columns from the losses (background, target) and numbers of tokens of its rows."""
    a, b = ([None if x is None else float(x[k]) for x in found] for k in (1, 0))
    gap = [None if x is None else x - y for x, y in zip(a, b, strict=True)]
    return {"n_tokens": pa.array(sizes, pa.int64()), "target_loss": pa.array(a, pa.float64()), "background_loss": pa.array(b, pa.float64()), "score": pa.array(gap, pa.float64())}


def flagged_rows(docs: DataFrame, target: DataFrame, stash: Stash, id_col: str, text_col: str) -> DataFrame:
    """``id, text, wanted`` of every row."""
    wanted = stash.save(target.select(F.col(id_col).alias("wanted_id")).where("wanted_id is not null").distinct(), "target")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(checked_broadcast(wanted), F.col("id") == F.col("wanted_id"), "left").select("id", "text", F.col("wanted_id").isNotNull().alias("wanted"))


def packed(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, compressed: the high bytes are mostly alike."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(cell: pa.Scalar, kind: str) -> np.ndarray:
    raw = cell.as_py()
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def block_hashes(group: pa.Table) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Tokens of a block's documents; of words and of pairs the distinct hashes, where each
    occurrence is among them, and where each document's occurrences begin and end."""
    found = [hashes(x.as_py()) for x in group["text"]]
    out = []
    for side in zip(*found, strict=True):
        keys, at = np.unique(np.concatenate(side), return_inverse=True)
        out.append((keys, at, np.cumsum([0, *map(len, side)])))
    return [len(x[0]) for x in found], out


def boxed(flagged: DataFrame) -> DataFrame:
    """``block, size, box``: the rows of ``id, text, wanted`` in blocks of about ``BLOCK_BYTES`` bytes of text.

    A block is a run of one task's rows, as a compressed Arrow stream; a longer text is a
    block of its own.  ``block`` is the task's number and the block's number in it.
    """

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def sent() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "box"])

        for batch in batches:
            sizes, begin = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")], 0
            for k, own in enumerate(sizes):
                if size and size + own > BLOCK_BYTES:
                    held.append(batch.slice(begin, k - begin))
                    yield sent()
                    block, held, size, begin = block + 1, [], 0, k
                size += own
            if len(sizes) > begin:
                held.append(batch.slice(begin))
        if held:
            yield sent()

    return flagged.mapInArrow(box, "block long, size long, box binary")


def unboxed(box: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(box.as_buffer()) as stream:
        return stream.read_all()


def answers(boxes: DataFrame, stash: Stash, buckets: int) -> DataFrame:
    """``block, kind, bucket, sums`` for every block, and with block -1 what all sum up to."""
    bounds = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, box in zip(batch.column("block").to_pylist(), batch.column("box"), strict=True):
                group = unboxed(box)
                wanted = group["wanted"].to_numpy()
                for kind, (keys, at, ends) in enumerate(block_hashes(group)[1]):
                    counts = np.stack([np.bincount(at, minlength=len(keys)), np.bincount(at[np.repeat(wanted, np.diff(ends))], minlength=len(keys))])
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    filled = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                    hashes = [packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in filled]
                    own = [packed(counts[:, a:b].astype("<i8")) for _, a, b in filled]
                    n = len(filled)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([k for k, *_ in filled], pa.int32()), pa.array(hashes, pa.binary()), pa.array(own, pa.binary())], ["block", "kind", "bucket", "hashes", "counts"])

    def add(group: pa.Table) -> pa.Table:
        kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
        sent = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in group["hashes"]]
        counts = np.concatenate([unpacked(x, "<i8").reshape(2, -1) for x in group["counts"]], 1)
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        # Sums of whole numbers below 2**53 are exact.
        sums = np.stack([np.bincount(at, c, len(keys)).astype("<i8") for c in counts])
        ends = np.cumsum([0, *map(len, sent)]).tolist()
        back = [packed(sums[:, at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({
            "block": pa.array([*group["block"].to_pylist(), -1], pa.int64()), "kind": pa.array([kind] * (len(back) + 1), pa.int32()), "bucket": pa.array([bucket] * (len(back) + 1), pa.int32()),
            "sums": pa.array([*back, packed(np.array([len(keys), *sums.sum(1)], "<i8"))], pa.binary()),
        })

    asked = boxes.mapInArrow(ask, "block long, kind int, bucket int, hashes binary, counts binary")
    asked = asked.repartition(-(-buckets // BUCKETS), "kind", "bucket")
    return stash.save(asked.groupBy("kind", "bucket").applyInArrow(add, "block long, kind int, bucket int, sums binary"), "answers")


def score(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, target_loss, background_loss, score`` of every row.

    ``target`` holds the ids of the target documents, each once.  Texts without words, null
    and empty ones have 0 tokens and null losses.  An empty target leaves its model
    uniform.  Repeated rows count repeatedly and are scored alike.  The vocabulary is as large as there are distinct words, ``WORDS`` at least.  Null ids are
    kept as they are; they are no target.  A text of any length is scored whole.
    """
    stash = Stash(docs.sparkSession, "lm")
    # Row groups of a few blocks, so that a task holds no more of them at once.
    boxes = stash.save(boxed(flagged_rows(docs, target, stash, id_col, text_col)), "boxes", **{"parquet.block.size": BLOCK_BYTES})
    size = boxes.agg(F.sum("size")).first()[0] or 0
    replies = answers(boxes, stash, max(BUCKETS, -(-size // BUCKET_BYTES)))
    # Files of past shuffles go when the driver collects its garbage; those to come are as large.
    docs.sparkSession.sparkContext._jvm.System.gc()
    types, tokens = 0, np.zeros(2, np.int64)
    for row in replies.where("block = -1 and kind = 0").toLocalIterator():
        n, *both = unpacked(pa.scalar(bytes(row["sums"])), "<i8").tolist()
        types, tokens = types + n, tokens + both
    types = max(types, WORDS)
    scale = float(tokens[1] / tokens[0]) if tokens[0] else 0.0

    def judge(box: pa.Table, told: pa.Table) -> pa.Table:
        group = unboxed(box["box"][0])
        sizes, sides = block_hashes(group)
        tables, told = [np.empty((2, 0))], told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = told["kind"].to_numpy()
        for kind, (keys, _, _) in enumerate(sides):
            sums = [unpacked(x, "<i8").reshape(2, -1) for x in told["sums"].filter(pa.array(kinds == kind))]
            tables.append(np.concatenate([np.empty((2, 0), np.int64), *sums], 1) * np.array([[scale], [1.0]]))
            if tables[-1].shape[1] != len(keys):
                raise ValueError("a block was not answered in full")
        table, found = np.concatenate(tables, 1), []
        for k, wanted in enumerate(group["wanted"].to_pylist()):
            words, pairs = (at[ends[k] : ends[k + 1]] for _, at, ends in sides)
            found.append(losses(words, len(sides[0][0]) + pairs, table, np.full(2, float(tokens[1])), np.array([scale, float(wanted)]), types))
        return pa.table({"id": group["id"], **columns(found, sizes)})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    scored = boxes.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(judge, schema)
    return scored.withColumnRenamed("id", id_col)
