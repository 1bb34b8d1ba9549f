"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Vectors are compared within their label.  Equal vectors are one class; the classes of a
label are dealt into shards of bounded size, and a layered small-world graph is built for
each.  Every class then queries the graph of every shard of its label, whatever its size.
A beam search starts in the top layer; a query whose whole beam is above the threshold goes
on with a wider beam, as there may be more.  In each pair of shards an audit holds some
queries against an exact scan: of their true links, and of their nearest neighbours where
few have links, at least ``RECALL`` must be found, else all queries go on with a wider beam.
Only queries that fill the widest beam, or whose audit still fails there, end in an exact
scan.  Links are verified by cosine in double precision.
A task returns link counts and one edge per vector to a local representative, so groups of
near copies never become all their pairs; the edges are joined into components.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, checked_broadcast
from .components import components

log = logging.getLogger(__name__)

#: Classes of a shard, about; links of a node above and in the bottom layer; beams.
SHARD, LINKS, BOTTOM, BUILD_BEAM, BEAM = 8192, 16, 32, 48, 32
#: Every so manyth query is audited, so many at least; queries handled at once; layers shrink by this factor.
AUDIT, AUDITED, BATCH, SHRINK = 20, 64, 512, 16
#: The widest beam; the share of an audit's links and nearest neighbours that must be found.
WIDEST, RECALL = 512, 0.98


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, best first (-1: none), and their similarities."""
    count, rows = len(queries), np.arange(len(queries))
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf, np.float32)
    open_ = np.zeros((count, beam), bool)
    width = min(beam, entry.shape[1])
    ids[:, :width] = entry[:, :width]
    near[:, :width] = np.einsum("qd,qkd->qk", queries, points[ids[:, :width]])
    near[ids < 0] = -np.inf
    open_[:, :width] = ids[:, :width] >= 0
    seen = np.zeros((count, len(points)), bool)
    r, c = np.nonzero(open_)
    seen[r, ids[r, c]] = True
    while len(rows):
        best = np.where(open_[rows], near[rows], -np.inf).argmax(1)
        going = open_[rows, best]
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        open_[rows, best] = False
        after = links[ids[rows, best]]
        fresh = (after >= 0) & ~seen[rows[:, None], after]
        r, c = np.nonzero(fresh)
        seen[rows[r], after[r, c]] = True
        found = np.where(fresh, np.einsum("qd,qkd->qk", queries[rows], points[after]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[rows], after], 1)
        all_near = np.concatenate([near[rows], found], 1)
        all_open = np.concatenate([open_[rows], fresh], 1)
        top = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
        ids[rows], near[rows], open_[rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_open))
        open_[rows] &= near[rows] > -np.inf
    order = np.argsort(-near, 1)
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, ids, -1), near


def spread(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links per node: those nearer to it than to any link chosen before, then the nearest left."""
    order = np.argsort(-near, 1)
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    there = near > -np.inf
    other = points[np.where(there, ids, 0)]
    between = np.einsum("qid,qjd->qij", other, other)
    chosen = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        closest = np.where(chosen[:, :k], between[:, k, :k], -np.inf).max(1, initial=-np.inf)
        chosen[:, k] = there[:, k] & (closest < near[:, k]) & (chosen.sum(1) < most)
    rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), 1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(ids, rank, 1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def exact_top(points: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    near = queries @ points.T
    k = min(k, near.shape[1])
    ids = np.argpartition(-near, k - 1, 1)[:, :k]
    return ids, np.take_along_axis(near, ids, 1)


class Graph:
    """Layered small-world graph over unit vectors in a random order; layer l holds a leading part of them."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray] | None = None):
        self.points = points
        self.layers = self._build() if layers is None else layers

    def _build(self) -> list[np.ndarray]:
        sizes = [len(self.points)]
        while sizes[-1] > 64:
            sizes.append(-(-sizes[-1] // SHRINK))
        self.layers = []
        for size in reversed(sizes):
            self.layers.append(self._layer(size, BOTTOM if size == sizes[0] else LINKS))
        return self.layers

    def _layer(self, size: int, most: int) -> np.ndarray:
        links = np.full((size, most), -1, np.int64)
        done = 0
        while done < size:
            step = min(size - done, BATCH, max(128, done))
            own = np.arange(done, done + step)
            queries = self.points[own]
            # The batch's nodes see each other exactly, and what is in the graph by search.
            ids, near = exact_top(queries, queries, BUILD_BEAM + 1)
            near = np.where(ids == np.arange(step)[:, None], -np.inf, near)
            ids = ids + done
            if done:
                entry = self.descend(queries, links, done)
                found, sims = beam_search(self.points[:done], links[:done], queries, entry, BUILD_BEAM)
                ids, near = np.concatenate([ids, np.maximum(found, 0)], 1), np.concatenate([near, np.where(found >= 0, sims, -np.inf)], 1)
            links[own] = spread(self.points, ids, near, most)
            self._answer(links, own, most)
            done += step
        return links

    def descend(self, queries: np.ndarray, links: np.ndarray, size: int) -> np.ndarray:
        """Entries for a layer whose first ``size`` nodes can be met: through the layers above it."""
        top = min(size, len(self.layers[0]) if self.layers else 64, 64)
        entry = exact_top(self.points[:top], queries, 1)[0]
        for layer in self.layers[1:]:
            if layer is not links and len(layer) <= size:
                entry = beam_search(self.points[: len(layer)], layer, queries, entry, 8)[0][:, :4]
        return entry

    def _answer(self, links: np.ndarray, own: np.ndarray, most: int) -> None:
        """Links back from the nodes that ``own`` link to; full nodes choose anew."""
        source, target = np.repeat(own, most), links[own].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        known = (links[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        if not len(source):
            return
        near = np.einsum("kd,kd->k", self.points[source], self.points[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        keep = rank < most
        extra = np.full((len(nodes), min(most, int(count.max()))), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = source[keep]
        for at in range(0, len(nodes), BATCH):
            part = nodes[at : at + BATCH]
            ids = np.concatenate([links[part], extra[at : at + BATCH]], 1)
            sims = np.einsum("qd,qkd->qk", self.points[part], self.points[np.maximum(ids, 0)])
            links[part] = spread(self.points, np.maximum(ids, 0), np.where(ids >= 0, sims, -np.inf), most)

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.descend(queries, self.layers[-1], len(self.points))
        return beam_search(self.points, self.layers[-1], queries, entry, beam)


def unit(points: np.ndarray) -> np.ndarray:
    """The vectors at length 1 in double precision, scaled first so that no square overflows."""
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.sqrt((points * points).sum(1, keepdims=True))


class Audit:
    """What a run of ``links_between`` did: queries answered by each beam and by scans, audited links there are and found."""

    def __init__(self):
        self.by_beam: dict[int, int] = {}
        self.scanned = self.wanted = self.found = 0


def links_between(graph: Graph, nodes: np.ndarray, exact: np.ndarray, threshold: float, same: bool, audit: Audit | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs with similarity of at least the threshold, in blocks; see the module's text.

    ``nodes`` and ``exact`` are the graph's vectors and the queries in double precision.
    """
    slack, queries, report = np.float32(threshold - 1e-5), exact.astype(np.float32), audit or Audit()

    def others(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node != q if same else np.ones(np.broadcast_shapes(q.shape, node.shape), bool)

    def scan(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(at), BATCH):
            q, node = np.nonzero(queries[at[k : k + BATCH]] @ graph.points.T >= slack)
            yield at[k : k + BATCH][q], node

    def sure(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = others(q, node)
        q, node = q[keep], node[keep]
        ok = np.empty(len(q), bool)
        for k in range(0, len(q), 1 << 16):
            at = slice(k, k + (1 << 16))
            ok[at] = np.einsum("kd,kd->k", exact[q[at]], nodes[node[at]]) >= threshold
        return q[ok], node[ok]

    # The audit: how many true links each of its queries has, and how near its nearest neighbour is.
    audited = np.unique(np.linspace(0, len(queries) - 1, min(len(queries), max(AUDITED, len(queries) // AUDIT))).astype(np.int64))
    want, nearest = np.zeros(len(queries), np.int64), np.full(len(queries), -np.inf, np.float32)
    for k in range(0, len(audited), BATCH):
        at = audited[k : k + BATCH]
        near = queries[at] @ graph.points.T
        if same:
            near[np.arange(len(at)), at] = -np.inf
        nearest[at] = near.max(1)
        q, node = np.nonzero(near >= slack)
        want += np.bincount(sure(at[q], node)[0], minlength=len(queries))
    todo, beam = np.arange(len(queries)), BEAM
    while len(todo) and beam <= WIDEST:
        pairs, full = [], np.zeros(len(queries), bool)
        best = np.full(len(queries), -np.inf, np.float32)
        for k in range(0, len(todo), BATCH):
            at = todo[k : k + BATCH]
            ids, near = graph.nearest(queries[at], beam)
            full[at] = near[:, -1] >= slack
            real = (ids >= 0) & others(at[:, None], ids)
            best[at] = np.where(real, near, -np.inf).max(1)
            q, c = np.nonzero(real & (near >= slack) & ~full[at][:, None])
            pairs.append(sure(at[q], ids[q, c]))
        asked = audited[np.isin(audited, todo) & ~full[audited]]
        got = sum(np.bincount(q, minlength=len(queries)) for q, _ in pairs)
        met = int((best[asked] >= nearest[asked] - 1e-5).sum())
        if got[asked].sum() >= RECALL * want[asked].sum() and met >= RECALL * len(asked):
            yield from pairs
            report.by_beam[beam] = len(todo) - int(full[todo].sum())
            report.wanted, report.found = report.wanted + int(want[asked].sum()), report.found + int(got[asked].sum())
            todo = todo[full[todo]]
        beam *= 4
    report.scanned = len(todo)
    for q, node in scan(todo):
        yield sure(q, node)


def gathered(graph: Graph, i: tuple[np.ndarray, ...], j: tuple[np.ndarray, ...], threshold: float, same: bool) -> pa.Table:
    """One row per vector with links: itself, its local representative, and how many it is linked to.

    ``i`` and ``j``: ids, copies and vectors of the graph's nodes and of the queries.  A last
    row without a node tells of the search: audited links, those found, and queries scanned.
    """
    ids = i[0] if same else np.concatenate([i[0], j[0]])
    shift = 0 if same else len(i[0])
    links, group, audit = np.zeros(len(ids), np.int64), np.arange(len(ids)), Audit()
    for q, node in links_between(graph, i[2], j[2], threshold, same, audit):
        links += np.bincount(q + shift, i[1][node], len(ids)).astype(np.int64)
        if not same:
            links += np.bincount(node, j[1][q], len(ids)).astype(np.int64)
        joined = np.unique(np.stack([group[q + shift], group[node]], 1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for a, b in joined.tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if parent:
            to = np.arange(len(ids))
            to[list(parent)] = [find(x) for x in parent]
            group = to[group]
    at = np.flatnonzero(links)
    long = lambda values, last: pa.array([*values.tolist(), last], pa.int64())
    none = np.full(len(at), None)
    return pa.table({"node": long(ids[at], None), "other": long(ids[group[at]], None), "links": long(links[at], None), "audited": long(none, audit.wanted), "met": long(none, audit.found), "scanned": long(none, audit.scanned)})


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """``id, n_links, component_id, kept`` of every vector.

    Vectors link if they have the same label and a cosine of at least ``threshold``;
    ``component_id`` is the least id that links reach.  Null, zero and non-finite vectors,
    vectors with null components and those with a null label or id link with nothing.  Vectors of
    different dimensions are never compared.
    Rows that repeat an id and vector count as copies of it; an empty table gives an empty
    result.
    """
    stash = Stash(vectors.sparkSession, "vectors")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("mark", F.when(usable, F.xxhash64("label", "v")))
    valid = rows.where("mark is not null")
    classes = valid.groupBy("mark", "label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stash.save(classes.withColumn("size", F.size("v")), "classes")
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = classes.join(checked_broadcast(stash.save(shards, "shards")), ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("shards")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        ids = group["rep"].to_numpy()
        order = np.argsort(ids)[np.random.Generator(np.random.PCG64(5)).permutation(len(ids))]
        points = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        layers = Graph(unit(points).astype(np.float32)).layers
        one = lambda x: pa.array([x], pa.binary())
        return pa.table({
            "label": group["label"][:1].combine_chunks(), "size": group["size"][:1].combine_chunks(), "shard": group["shard"][:1].combine_chunks(),
            "ids": one(ids[order].astype("<i8").tobytes()), "copies": one(group["copies"].to_numpy()[order].astype("<i8").tobytes()), "points": one(points.astype("<f8").tobytes()),
            "layers": pa.array([[x.astype("<i4").tobytes() for x in layers]], pa.list_(pa.binary())), "widths": pa.array([[x.shape[1] for x in layers]], pa.list_(pa.int32())),
        })

    label = classes.schema["label"].dataType.simpleString()
    schema = f"label {label}, size int, shard int, ids binary, copies binary, points binary, layers array<binary>, widths array<int>"
    graphs = stash.save(dealt.select("label", "size", "shard", "rep", "copies", "v").repartition("label", "size", "shard").groupBy("label", "size", "shard").applyInArrow(build, schema), "graphs")
    # Pairs are listed without the graphs, so that a label's pairs are dealt out one by one.
    named = lambda c: graphs.select("label", "size", F.col("shard").alias(c))
    side = lambda c, *names: graphs.select("label", "size", F.col("shard").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names])
    pairs = named("i").join(named("j"), ["label", "size"]).where("i <= j")
    pairs = pairs.join(side("i", "ids", "copies", "points", "layers", "widths"), ["label", "size", "i"]).join(side("j", "ids", "copies", "points"), ["label", "size", "j"]).repartition("label", "size", "i", "j")

    def compare(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]

        def side(c: str) -> tuple[np.ndarray, ...]:
            ids = np.frombuffer(row[f"ids_{c}"], "<i8")
            return ids, np.frombuffer(row[f"copies_{c}"], "<i8"), unit(np.frombuffer(row[f"points_{c}"], "<f8").reshape(len(ids), -1))

        i, j = side("i"), side("j")
        layers = [np.frombuffer(x, "<i4").astype(np.int64).reshape(-1, w) for x, w in zip(row["layers_i"], row["widths_i"], strict=True)]
        return gathered(Graph(i[2].astype(np.float32), layers), i, j, threshold, row["i"] == row["j"])

    every = stash.save(pairs.groupBy("label", "size", "i", "j").applyInArrow(compare, "node long, other long, links long, audited long, met long, scanned long"), "found")
    told = every.where("node is null").agg(F.sum("audited").alias("audited"), F.sum("met").alias("met"), F.sum("scanned").alias("scanned")).first()
    log.info("%s of %s audited links found by graph search; %s queries answered by exact scans", told["met"], told["audited"], told["scanned"])
    found = every.where("node is not null").select("node", "other", "links")
    roots = stash.save(components(stash, found.select("node", "other")), "roots")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(links, F.col("rep") == F.col("node"), "left").drop("node").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("mark", "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = valid.select("id", "mark", "label", "v").join(known, ["mark", "label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("mark is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
