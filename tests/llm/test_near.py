import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loamline.llm import near_vectors, ngram_join, shingles
from loamline.llm.common import Stash
from loamline.llm.components import components
from loamline.llm.shingles import shingle_set

from .fixtures import awkward_rows, frame, words


class Joined:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_sets(rows):
    out = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(rows):
    sets, holders, common = plain_sets(rows), defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    joined = Joined(sets)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            joined.join(a, b)
    return sorted((i, len(sets[i]), joined.find(i)) for i in sets)


def edited(rng, text, share):
    parts = text.split(" ")
    for _ in range(max(1, int(len(parts) * share))):
        parts[rng.randrange(len(parts))] = f"n{rng.randrange(9)}"
    return " ".join(parts)


def test_shingle_sets_have_the_right_sizes():
    for i, n in ((i, len(s)) for i, s in plain_sets(awkward_rows()).items()):
        assert len(shingle_set({r[0]: r[1] for r in awkward_rows()}[i])) == n


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, 300), "x" * 500 + " y " + "Z" * 333, " " * 400, " a" * 200, "é" * 300 + "\t" + words(rng, 40), "q" * 1000]
    whole = [shingles.word_hashes(t) for t in texts]
    assert [len(w) for w in whole] == [len(t.split()) for t in texts]
    monkeypatch.setattr(shingles, "PIECE", 40)
    for t, w in zip(texts, whole, strict=True):
        assert (shingles.word_hashes(t) == w).all() and len(shingles.word_hashes(t)) == len(w)


def test_keys_and_sketches_never_miss_a_link():
    rng = random.Random(2)
    for size in [6, 8, 12, 20, 24, 25, 29, 33, 40, 60, 64, 90, 128, 200, 300, 700, 2000]:
        for _ in range(8):
            a = shingle_set(words(rng, size + 4, 100_000))
            drop = rng.randrange(0, max(1, len(a) // 7) + 1)
            b = np.unique(np.concatenate([a[drop:], shingle_set(words(rng, max(0, drop - 1) + 4, 100_000))[:drop]]))
            if ngram_join.linked(a, b, 75):
                assert np.intersect1d(ngram_join.join_keys(a, 75), ngram_join.join_keys(b, 75)).size
                x, y = ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)
                w = min(len(x), len(y))
                apart = int(np.bitwise_count(ngram_join.cut_to(x, w) ^ ngram_join.cut_to(y, w)).sum())
                assert apart <= len(np.setxor1d(a, b)) <= ngram_join.most_apart(len(a), len(b), 75)


def test_linked_sets_share_a_key_at_every_size_and_edge():
    """Pairs at the largest difference that a link allows, also across the borders of bands."""
    rng = np.random.default_rng(7)
    for a in [*range(5, 140), *range(140, 2100, 37)]:
        for b in {a, a + 1, a * 4 // 3, (a + a * 4 // 3) // 2}:
            least = -(-75 * (a + b) // 175)
            if 100 * least < 75 * (a + b - least) or least > a:
                continue
            for _ in range(6):
                every = rng.integers(0, 1 << 63, a + b - least, np.uint64) * np.uint64(2)
                x, y = np.unique(every[:a]), np.unique(np.concatenate([every[:least], every[a:]]))
                assert ngram_join.linked(x, y, 75)
                assert np.intersect1d(ngram_join.join_keys(x, 75), ngram_join.join_keys(y, 75)).size, (a, b)


def test_sets_that_hash_badly_are_found_by_single_shingles():
    """All shingles of both sets in one segment of their layout: no segment needs to agree."""
    rng, band = np.random.default_rng(3), 6
    salt = ngram_join.mixed(np.array([band + 1], np.uint64))
    many = rng.integers(0, 1 << 63, 400_000, np.uint64)
    one = many[ngram_join.mixed(many ^ salt) % np.uint64(ngram_join.segments_of(band, 75)) == 0][:120]
    x, y = np.unique(one[:100]), np.unique(one[3:103])
    assert len(x) == 100 and ngram_join.linked(x, y, 75)
    assert np.intersect1d(ngram_join.join_keys(x, 75), ngram_join.join_keys(y, 75)).size


def test_rows_that_repeat_an_id_are_one_document(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 40) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, edited(rng, d, 0.01)), (21, d), (22, c), (2, None), (2, ""), (30, "x y"), (30, None)]
    rows += [(40, c + " more")] * 300
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(frame(spark, [(*r, "en", "s") for r in rows])).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (20, 20), (21, 20), (22, 20), (2, 2), (30, 30), (40, 20)}


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    rows = awkward_rows(plain=80)
    passage = words(rng, 60)
    for k in range(60):  # a chain of edits, a passage that many share, a big group of near copies
        rows.append((1000 + k, edited(rng, rows[40][1] + " " + words(rng, 150, 50), 0.02) if k == 0 else edited(rng, rows[-1][1], 0.03), "en", "s0"))
    rows += [(2000 + k, f"{words(rng, 40)} {passage} {words(rng, 40)}", "en", "s0") for k in range(60)]
    rows += [(3000 + k, edited(rng, passage, rng.choice([0.01, 0.05])), "en", "s0") for k in range(80)]
    got = sorted(set(tuple(r) for r in ngram_join.ngram_components(frame(spark, rows)).collect()))
    assert got == plain_components(rows)
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []


def test_blocks_of_a_large_key_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    base = [words(rng, 40) for _ in range(4)]
    rows = [(k, edited(rng, base[k % 4], 0.06), "en", "s") for k in range(90)]
    assert sorted(tuple(r) for r in ngram_join.ngram_components(frame(spark, rows)).collect()) == plain_components(rows)


def test_components_of_a_graph(spark):
    rng, joined = random.Random(8), Joined(range(500))
    edges = [(k, k + 1) for k in range(100)] + [(200, k) for k in range(201, 280)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7)]
    for a, b in edges:
        joined.join(a, b)
    got = {r.node: r.root for r in components(Stash(spark, "test"), spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: joined.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(Stash(spark, "test"), spark.createDataFrame([], "x long, y long")).collect() == []


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 0, 0, 1, 2):
        center = rng.normal(size=(30, 16))
        for c in center:
            rows += [(label, (c + rng.normal(size=16) * s).astype(np.float32).tolist()) for s in (0, 0.05, 0.12, 0.2)]
    near = rng.normal(size=16)
    rows += [(1, (near + rng.normal(size=16) * 0.03).astype(np.float32).tolist()) for _ in range(120)]
    rows += [(1, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (0, (np.array(rows[0][1]) * 3).tolist())]
    rows += [(None, rows[0][1]), (0, None), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [float("inf")] + [0.0] * 15), (0, [None] + [1.0] * 15), (0, []), (5, [1.0, 2.0]), (5, [2.0, 4.0])]
    return [(i, v, label) for i, (label, v) in enumerate(rows)]


def plain_vectors(rows, threshold=0.98):
    joined, n = Joined(r[0] for r in rows), defaultdict(int)

    def fine(v):
        return v and None not in v and np.isfinite(v).all() and np.any(v)

    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and fine(v)]
    for k, (i, v, label) in enumerate(good):
        for j, w, other in good[k + 1 :]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                n[i] += 1
                n[j] += 1
                joined.join(i, j)
    return sorted((i, n[i], joined.find(i), joined.find(i) == i) for i, *_ in rows)


@pytest.mark.parametrize("shard", [8192, 60])
def test_vectors_equal_brute_force(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id long, v string").repartition(3)
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df, shard=shard).collect())
    want = plain_vectors([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert [r[0] for r in got] == [r[0] for r in want]
    links = sum(r[1] for r in want)
    assert sum(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) <= 0.01 * links
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert near_vectors.near_vectors(df.limit(0)).collect() == []


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    points = near_vectors.unit(rng.normal(size=(3000, 24))).astype(np.float32)
    graph = near_vectors.Graph(points)
    ids, _ = graph.nearest(points[::50], 96)
    want = np.argsort(-(points[::50] @ points.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :30].tolist(), want.tolist(), strict=True)]) >= 0.9


def test_links_found_through_a_graph_equal_brute_force():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(400, 24))
    points = near_vectors.unit(np.concatenate([centers + rng.normal(size=centers.shape) * s for s in (0, 0.05, 0.08, 0.1, 0.12, 0.15)] + [centers[:1] + rng.normal(size=(300, 24)) * 0.03]))
    order = rng.permutation(len(points))
    points = points[order]
    graph, audit = near_vectors.Graph(points.astype(np.float32)), near_vectors.Audit()
    got = [(a, b) for q, n in near_vectors.links_between(graph, points, points, 0.98, True, audit) for a, b in zip(q.tolist(), n.tolist(), strict=True)]
    assert sum(audit.by_beam.values()) >= len(points) - 301 and audit.scanned <= 301
    near = points @ points.T
    np.fill_diagonal(near, -1)
    want = set(zip(*(x.tolist() for x in np.nonzero(near >= 0.98)), strict=True))
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(want & set(got)) >= 0.999 * len(want)


@pytest.mark.parametrize("count", [3, 40, 200, 900])
def test_small_shards_are_searched_by_their_graphs(count):
    rng = np.random.default_rng(count)
    points = near_vectors.unit(np.repeat(rng.normal(size=(-(-count // 3), 24)), 3, 0)[:count] + rng.normal(size=(count, 24)) * 0.05)
    graph, audit = near_vectors.Graph(points.astype(np.float32)), near_vectors.Audit()
    got = sorted((a, b) for q, n in near_vectors.links_between(graph, points, points, 0.98, True, audit) for a, b in zip(q.tolist(), n.tolist(), strict=True))
    near = points @ points.T
    np.fill_diagonal(near, -1)
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(near >= 0.98)), strict=True))
    assert sum(audit.by_beam.values()) == count and audit.scanned == 0


def test_an_audit_widens_beams_that_miss_links(monkeypatch):
    rng = np.random.default_rng(2)
    points = near_vectors.unit(np.repeat(rng.normal(size=(400, 24)), 3, 0) + rng.normal(size=(1200, 24)) * 0.05)
    graph, searched = near_vectors.Graph(points.astype(np.float32)), []
    whole = near_vectors.Graph.nearest

    def blind(self, queries, beam):
        searched.append(beam)
        ids, near = whole(self, queries, beam)
        return (ids, near) if beam > 32 else (np.full_like(ids, -1), np.full_like(near, -np.inf))

    monkeypatch.setattr(near_vectors.Graph, "nearest", blind)
    audit = near_vectors.Audit()
    got = sum(len(q) for q, _ in near_vectors.links_between(graph, points, points, 0.98, True, audit))
    near = points @ points.T
    np.fill_diagonal(near, -1)
    assert got == (near >= 0.98).sum() and {32, 128} <= set(searched) and audit.by_beam == {128: 1200}
