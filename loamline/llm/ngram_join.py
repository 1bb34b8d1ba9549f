"""N-gram Jaccard join: parity sketches, a pigeonhole join on their segments, verification.

A set of shingles is dealt by hash into segments, and the hashes in a segment are XORed.
A shingle that only one of two sets has changes one segment alone, so the number of
segments that differ is at most the symmetric difference, and for sets with similarity t
that is at most (1 - t) / (1 + t) of their sizes together.  Sets are compared within size
bands, each with a layout of its own; every filled segment of it is a key of the join.  A
set with more filled segments than can differ shares a key with whatever it is linked to:
that is the pigeonhole principle, and it is checked for every set.  The few sets that hash
badly, and sets of few shingles, have single shingles as segments besides: two linked sets
share one of their first (1 - t) n + 1 shingles in a common order.  So no link is missed
(but for equal 64-bit hashes of different shingles).

Two sets that share a key are compared by a parity bit sketch, whose Hamming distance is
a lower bound of the symmetric difference too, and what passes is verified on the shingle
sets.  Equal sets are one class before all that.  Of the sets that share a key, first each
is compared with the least.  Two sets that share a key so are partners of the same least
set: among the partners of a set, those that are still in different components are then
compared, in blocks.  So groups of near copies never become all their pairs, yet every
pair that shares a key is either compared or known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, checked_broadcast
from .components import components
from .shingles import mixed, shingle_set

#: Sets with up to so many shingles are found by single shingles; those with more by segments.
FEW = 24
#: Expected filled segments of the largest sets of a band, over what can differ.
MARGIN = 1.2
#: Keys that a task sends on at once, and about how many a task sorts; the most such tasks.
KEYS_AT_ONCE, TASK_KEYS, MOST_TASKS = 1 << 19, 1 << 20, 1 << 15
#: Partners of a set that a block of the second comparison holds; pairs of a set that one group verifies.
BLOCK = 1024


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def first_shingles(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the first shingles in the order of their hashes: linked sets share one of them."""
    return mixed(hashes[: len(hashes) - least_overlap(len(hashes), percent) + 1] ^ np.uint64(0x51))


@lru_cache(maxsize=256)
def segments_of(band: int, percent: int) -> int:
    """Segments that sets of 2 ** band to 2 ** (band + 1) - 1 shingles are dealt into."""
    top = (2 << band) - 1
    most = most_apart(top, top * 100 // percent, percent)
    size = most + 1
    while size < 8 * top and size * -np.expm1(-top / size) < MARGIN * most + 2:
        size += max(1, size // 16)
    return size


def join_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a sorted set of shingle hashes.

    A set is laid out in its band, and in the band below if that holds sets it can be linked
    to.  What can differ there is bounded by the set's size and the band's.
    """
    n, keys, sure = len(hashes), [], True
    if n > FEW:
        own = n.bit_length() - 1
        for band in [own, own - 1] if n * percent < 100 << own and 1 << own > FEW + 1 else [own]:
            segments = segments_of(band, percent)
            salt = mixed(np.array([band + 1], np.uint64))
            dealt = mixed(hashes ^ salt) % np.uint64(segments)
            order = np.argsort(dealt, kind="stable")
            which = dealt[order]
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            parity = np.bitwise_xor.reduceat(hashes[order], first)
            keys.append(mixed(parity + which[first] * np.uint64(0xD6E8FEB86659FD93) + salt))
            # In its own band a set's partners are at most so large; in the band below they are smaller than it.
            partner = n * 100 // percent if band == own else (2 << band) - 1
            sure &= len(first) > most_apart(n, partner, percent)
    if n * percent <= FEW * 100 or not sure:
        keys.append(first_shingles(hashes, percent))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits (uint64 words): each shingle flips one of at least twice as many bits as shingles."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    flips = np.bincount((hashes >> np.uint64(7) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<u8")


def cut_to(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with fewer bits: halves are XORed, as a shingle's place is its hash modulo the bits."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def most_apart(a, b, percent: int):
    """The largest symmetric difference that two linked sets of these sizes can have."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, and its bit sketch."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                hashes = shingle_set(cell.as_py())
                digest = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8")
                rows.append((len(hashes), int(digest[0]), int(digest[1]), bit_sketch(hashes).tobytes() if len(hashes) else b""))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [*[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc", "n", "h1", "h2", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(mark, "doc long, n long, h1 long, h2 long, sketch binary")


def keyed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``key, doc`` of every join key of every text; repeated ones of a batch come once."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = join_keys(shingle_set(cell.as_py()), percent).view(np.int64)
                held.append(np.stack([own, np.full(len(own), doc, np.int64)]))
                size += len(own)
                if size >= KEYS_AT_ONCE:
                    yield sent(held)
                    held, size = [], 0
            if held:
                yield sent(held)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = np.concatenate(held, 1)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]
        return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(doc[new])], ["key", "doc"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(lay_out, "key long, doc long")


def stars_of(keyed: DataFrame, tasks: int) -> DataFrame:
    """``a, b`` for every document ``b`` that has a key whose least document is ``a``, another one.

    One pass over the sorted keys; most are of one document and go here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and least document of the batch before
        for batch in batches:
            key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc"))
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = doc[at]
            if last is not None and last[0] == key[0]:
                least[0] = last[1]
            least = np.repeat(least, np.diff(np.append(at, len(key))))
            last = (key[-1], least[-1])
            kept = doc != least
            yield pa.RecordBatch.from_arrays([pa.array(x[kept], pa.int64()) for x in (least, doc)], ["a", "b"])

    return keyed.repartition(tasks, "key").sortWithinPartitions("key", "doc").mapInArrow(run, "a long, b long").distinct()


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bit sketches do not rule a link out."""
    side = lambda c: sketches.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                words = min(len(x), len(y))
                keep.append(int(np.bitwise_count(cut_to(x, words) ^ cut_to(y, words)).sum()) <= most_apart(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(compare, "a long, b long")


def verified(stash: Stash, pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """The pairs whose shingle sets reach the threshold; the sets are made anew from the texts.

    Pairs are dealt out by their first document, at most about ``BLOCK`` to a group, in which
    that document's set comes once, before those of its partners.
    """
    ids = stash.save(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), f"{name}-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(checked_broadcast(ids), "doc", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            marks = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks, pa.array(found, pa.binary())], ["doc", "mark", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            a, b = [], []
            for first, part, second, hashes in zip(*(batch.column(c) for c in ("a", "part", "b", "hashes")), strict=True):
                first, second, found = first.as_py(), second.as_py(), np.frombuffer(hashes.as_buffer(), "<u8")
                if (first, part.as_py()) != group:
                    group, own = (first, part.as_py()), []
                if second is None:
                    own.append(found.copy())
                elif any(linked(x, found, percent) for x in own):
                    a.append(first)
                    b.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    own = texts.mapInArrow(sets, "doc long, mark binary, hashes binary").groupBy("doc", "mark").agg(F.first("hashes").alias("hashes"))
    own = stash.save(own.select("doc", "hashes"), f"{name}-sets")
    many = stash.save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), f"{name}-many")
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    firsts = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = lambda c: own.select(F.col("doc").alias(c), "hashes")
    both = firsts.join(side("a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "hashes").union(dealt.join(side("b"), "b").select("a", "part", "b", "hashes"))
    out = both.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(compare, "a long, b long")
    out = stash.save(out.distinct(), f"{name}-links")
    stash.drop(f"{name}-ids", f"{name}-sets", f"{name}-many")
    return out


def blocked(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among the partners of a set that the bit sketches do not rule out.

    ``members``: a (the set), x, y (the blocks compared), own (this row's block), doc, root, n, sketch.
    """

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[6], r[4]))
        own, doc, root, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5, 6))
        words = np.array([len(r[7]) // 8 for r in rows])
        inside, most, out = rows[0][1] == rows[0][2], np.searchsorted(n, n * 100 // percent, "right"), []
        level = 0
        for i in range(len(rows) - 1):
            if words[i] != level:
                # Sizes ascend, and so do sketches: from here on all have this many words at least.
                level, base = words[i], i
                bits = np.stack([cut_to(np.frombuffer(r[7], "<u8"), level) for r in rows[i:]])
            at = np.arange(i + 1, most[i])
            at = at[(root[at] != root[i]) & (inside | (own[at] != own[i]))]
            if len(at):
                apart = np.bitwise_count(bits[at - base] ^ bits[i - base]).sum(1)
                out += [(min(int(doc[i]), d), max(int(doc[i]), d)) for d in doc[at[apart <= most_apart(n[at], n[i], percent)]].tolist()]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(found: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        rows: list[tuple] = []
        for batch in batches:
            found = set()
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    found.update(flush(rows))
                    rows = []
                rows.append(row)
            yield sent(found)
        if rows:
            yield sent(set(flush(rows)))

    columns = ["a", "x", "y", "own", "doc", "root", "n", "sketch"]
    return members.select(columns).repartition("a", "x", "y").sortWithinPartitions("a", "x", "y").mapInArrow(compare, "a long, b long")


def ngram_components(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row: the least id that its links reach.

    Rows are linked when 100 * |A and B| >= percent * |A or B| for their sets of five-word
    shingles; ``percent`` is 50 at least.  Texts without words, null and empty ones have no
    shingles and no links.  Equal texts are linked; rows that repeat an id are one document,
    whose links are those of all its texts.  A row without an id links nothing and has the
    component of its text, or null.  Very long texts are taken whole.  An empty table gives
    an empty result; further columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    stash = Stash(docs.sparkSession, "ngrams")
    marks = stash.save(marked(docs, id_col, text_col), "marks")
    filled = marks.where("n > 0 and doc is not null")
    reps = stash.save(filled.groupBy("h1", "h2").agg(F.min(F.struct("doc", "n", "sketch")).alias("x")).select("h1", "h2", "x.*"), "reps")
    sketches = reps.select("doc", "n", "sketch")
    # Keys are laid out from the texts of representatives: no table holds them beside the shuffle.
    nodes = checked_broadcast(reps.select("doc"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(nodes, "doc", "left_semi")
    tasks = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (reps.agg(F.sum("n")).first()[0] or 0) // TASK_KEYS))
    stars = stash.save(stars_of(keyed(texts, percent, "doc", "text"), tasks), "stars")
    # Rows that repeat an id tie the classes of their texts together.
    several = filled.groupBy("doc").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("doc")
    several = stash.save(several, "several")
    texts_of = filled.select("doc", "h1", "h2").join(checked_broadcast(several), "doc", "left_semi").distinct()
    same = stash.save(texts_of.join(reps.select("h1", "h2", F.col("doc").alias("a")), ["h1", "h2"]).select("a", F.col("doc").alias("b")), "same")

    first = verified(stash, stash.save(near_enough(stars, sketches, percent), "near1"), docs, percent, id_col, text_col, "first")
    roots = stash.save(components(stash, first.union(same), "cc-a"), "roots")

    # Sets whose partners are not yet one component: those are compared with each other.
    placed = stash.save(stars.join(roots, F.col("b") == F.col("node"), "left").select("a", F.col("b").alias("doc"), F.coalesce("root", "b").alias("root")), "placed")
    mixed_stars = placed.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    mixed_stars = stash.save(mixed_stars.select("a", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
    members = placed.join(checked_broadcast(mixed_stars), "a").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("a", "doc", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    pairs = blocked(members.join(sketches, "doc"), percent).distinct().join(stars, ["a", "b"], "left_anti")
    second = verified(stash, stash.save(pairs, "near2"), docs, percent, id_col, text_col, "second")
    roots = stash.save(components(stash, first.union(second).union(same), "cc-b"), "linked")

    # Every node's least id is its root, as a class's node is its least id.
    label = reps.join(roots, F.col("doc") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "doc").alias("component_id"))
    out = marks.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "h1", "h2").join(label, ["h1", "h2"], "left")
    return out.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
