"""Operators that keep a count of everything they saw, held against plain counting."""

import math
from collections import Counter

import pytest

from loamline.llm import lm_scoring

from .fixtures import awkward_rows, frame


def plain_losses(rows, chosen, types):
    """Losses by the definition, over words and pairs themselves; A-Z count as a-z."""
    split = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()] for i, t, *_ in rows}
    n = [Counter(), Counter()]
    for i, *_ in rows:
        for k in (0, 1) if i in chosen else (0,):
            n[k].update([(w,) for w in split[i]] + list(zip(split[i], split[i][1:])))
    tokens = [sum(c for g, c in m.items() if len(g) == 1) for m in n]
    scale, out = tokens[1] / tokens[0], {}
    for i, words in split.items():
        own, both = Counter([(w,) for w in words] + list(zip(words, words[1:]))), []
        for k, factor, weight in ((1, 1.0, float(i in chosen)), (0, scale, scale)):
            left = lambda g, k=k, factor=factor, weight=weight: max(n[k][g] * factor - weight * own[g], 0)
            total = 0.0
            for t, w in enumerate(words):
                p = (left((w,)) + lm_scoring.FLOOR) / (tokens[1] - weight * len(words) + lm_scoring.FLOOR * types)
                if t:
                    p = (left((words[t - 1], w)) + lm_scoring.PRIOR * p) / (left((words[t - 1],)) + lm_scoring.PRIOR)
                total -= math.log(p)
            both.append(total / len(words) if words else None)
        out[i] = (len(words), *both)
    return out


def test_every_word_and_pair_has_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS", 16)
    rows, chosen = awkward_rows(), {1, 3, 5, 7, 9}
    target = spark.createDataFrame([(i,) for i in (1, 3, 5, 7, 9, 9, None)], "doc_id long")
    types = len({w.lower() for _, t, *_ in rows for w in (t or "").split()})
    assert types > lm_scoring.WORDS
    want = plain_losses(rows, chosen, types)
    got = lm_scoring.score(frame(spark, rows), target).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n
        if not n:
            assert r.target_loss is r.background_loss is r.score is None
        else:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((a, b, a - b), rel=1e-6, abs=1e-9)
    assert lm_scoring.score(frame(spark, []), target).collect() == []
    none = lm_scoring.score(frame(spark, rows[:9]), target.limit(0)).collect()
    assert all(r.score is None or abs(r.score) < 1e-6 for r in none)
