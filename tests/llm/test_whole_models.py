import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loamline.llm import url_filter
from loamline.llm.common import Stash

from .test_native import plain_models


def test_no_counted_sequence_is_lost(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz-/."
    train = [("^^^^" + "".join(rng.choice(letters) for _ in range(40)), k % 2 == 0) for k in range(1500)]
    stash = Stash(spark, "test")
    model = stash.save(url_filter.models(stash, spark.createDataFrame(train, "text string, accepted boolean")), "model")
    counts, totals, p = plain_models(train)
    counted = dict(counts)
    assert len(counted) > 1 << 15 and model.count() == len(counted)
    asked = spark.createDataFrame([(t,) for t, _ in train[:40]] + [("^^^^http://zz.zz",)], "text string")
    table = stash.save(url_filter.as_value(model), "table")
    got = asked.select("text", table.scalar().alias("t")).select("text", url_filter.score(F.col("text"), F.col("t")).alias("score"))
    for r in got.collect():
        total = 0.0
        for end in range(url_filter.ORDER, len(r.text) + 1):
            g = r.text[end - url_filter.ORDER : end]
            total += math.log(p(g, 0) / p(g, 1))
        assert r.score == pytest.approx(total / (len(r.text) - url_filter.ORDER + 1), abs=1e-9)


def test_threshold_and_verdicts_equal_the_definition(spark):
    """Counted and held URLs, the threshold with the best balanced accuracy, and what no rule settles."""
    rng = random.Random(11)
    rules = [("com", "/", "allow"), ("net", "/", "block")]
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    urls = [f"http://{word('abcdefg')}.com/{word('abcxyz')}" for _ in range(150)] + [f"http://{word('defghij')}.net/{word('pqxyz')}" for _ in range(140)]
    urls += [f"http://{word('abcdefghij')}.org/{word('abcpqxyz')}" for _ in range(80)] + [None, "", "no scheme"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}

    digits = str.maketrans("123456789", "0" * 9)
    folded = lambda url: "^^^^" + (url or "").lower().translate(digits)
    labelled = [(u, ".com/" in u) for u in urls if u and (".com/" in u or ".net/" in u)]
    held = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u, _ in labelled]
    held = [(h - (1 << 64) if h >> 63 else h) % 5 == 0 for h in held]
    assert 0 < sum(held) < len(held)
    counts, totals, p = plain_models([(folded(u), a) for (u, a), h in zip(labelled, held, strict=True) if not h])
    counted = dict(counts)

    def score(url):
        text, total = folded(url), 0.0
        for end in range(url_filter.ORDER, len(text) + 1):
            value = 0.0
            for n in range(1, url_filter.ORDER + 1):
                g = text[end - n : end]
                if g in counted:
                    value = math.log(p(g, 0) / p(g, 1))
                elif n > 1 and g[:-1] in counted:
                    value += math.log((totals[g[:-1]][1] + url_filter.PRIOR) / (totals[g[:-1]][0] + url_filter.PRIOR))
            total += value
        return total / (len(text) - 4) if len(text) > 4 else 0.0

    seen = [(math.floor(score(u) * url_filter.STEPS), a) for (u, a), h in zip(labelled, held, strict=True) if h]
    share = lambda step, kind: sum(s >= step for s, a in seen if a == kind) / max(1, sum(a == kind for _, a in seen))
    best = max({s for s, _ in seen}, key=lambda step: (share(step, True) - share(step, False), -step)) / url_filter.STEPS
    for k, url in enumerate(urls):
        assert got[k].score == pytest.approx(score(url), abs=1e-9)
        if got[k].rule is None and abs(score(url) - best) > 1e-9:
            assert got[k].verdict == ("allow" if score(url) >= best else "block")
    assert {got[k].verdict for k in got if got[k].rule is None} == {"allow", "block"}


def test_every_labelled_url_is_counted_or_held(spark, monkeypatch):
    asked, models = [], url_filter.models

    def counted(stash, examples):
        asked.append(examples.count())
        return models(stash, examples.limit(40))

    monkeypatch.setattr(url_filter, "models", counted)
    pages = spark.range(450_000).select(F.when(F.col("id") % 2 == 0, "a://com/").otherwise("b://net/").alias("url"), "id").select(F.concat("url", "id").alias("url"))
    url_filter.filter_urls(pages, [("com", "/", "allow"), ("net", "/", "block")])
    assert asked == [pages.where(F.pmod(F.xxhash64("url"), F.lit(5)) != 0).count()]


def test_a_model_dealt_over_several_tables_scores_alike(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    urls = [f"http://{word('abcdefg')}.com/{word('abcxyz')}" for _ in range(90)] + [f"http://{word('defghij')}.net/{word('pqxyz')}" for _ in range(90)]
    urls += [f"http://{word('abcdefghij')}.org/^{word('abcpqxyz')}" for _ in range(60)] + [None, "", "^", "^^^^a", "x"]
    pages = spark.createDataFrame([(k, u, 7) for k, u in enumerate(urls)], "page_id long, url string, score int")
    rules = [("com", "/", "allow"), ("net", "/", "block")]
    whole = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    monkeypatch.setattr(url_filter, "HELD", 900)
    calls, as_value = [], url_filter.as_value
    monkeypatch.setattr(url_filter, "as_value", lambda rows, part, parts: calls.append(parts) or as_value(rows, part, parts))
    dealt = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(calls) > 2 and set(calls) == {len(calls)} and len(dealt) == len(urls)
    for k, r in whole.items():
        assert dealt[k].score == pytest.approx(r.score, abs=1e-9) and dealt[k].verdict == r.verdict
