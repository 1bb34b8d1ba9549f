import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from loamline.llm import language, registry
from loamline.llm.shingles import word_hashes

from .fixtures import SF, awkward_rows, frame


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    rows = awkward_rows()
    got = language.identify(frame(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert language.identify(frame(spark, [])).collect() == []
    unknown = language.identify(frame(spark, [(1, "some text", None, None), (2, None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in unknown] == [("und", 0.0)] * 2


def test_document_frequencies_cover_all_rows(spark):
    texts = [r[1] or "" for r in awkward_rows()]
    df, n = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    want = np.zeros(language.FEATURES, int)
    for t in texts:
        want[language.term_frequencies(t)[0]] += 1
    assert n == len(texts) and (df == want).all()


def plain_ngrams(text):
    """Every n-gram occurrence by the definition: lower case, other characters than letters one blank."""
    folded, out = "", []
    for c in f" {text.lower()} ":
        c = c if c.isalpha() or ord(c) > 0xFFFF else " "
        folded += "" if c == " " and folded.endswith(" ") else c
    for n in range(1, language.ORDERS + 1):
        for k in range(len(folded) - n + 1):
            value = 0
            for place, c in enumerate(folded[k : k + n]):
                value = (value * 0x9E3779B97F4A7C15 + ord(c) + place + 1) % 2**64
            out.append(((value ^ value >> 29) * 0xBF58476D1CE4E5B9) % 2**64 >> 49)
    return out


def test_ngrams_equal_the_definition_whatever_the_parts(monkeypatch):
    for size in (1 << 15, 7):
        monkeypatch.setattr(language, "AT_ONCE", size)
        for text in [r[1] or "" for r in awkward_rows(plain=10) if len(r[1] or "") < 2000]:
            want = plain_ngrams(text)
            assert sorted(x for part in language.ngram_parts(text) for x in part.tolist()) == sorted(want)
            found, share = language.term_frequencies(text)
            assert {int(f): round(s * len(want)) for f, s in zip(found, share, strict=True)} == Counter(want)


def plain_ftrl(examples, langs, classes):
    """Follow-the-regularised-leader, coordinate by coordinate, over dicts."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        v = z[f, c]
        return 0.0 if abs(v) <= language.L1 else -(v - math.copysign(language.L1, v)) / ((language.BETA + math.sqrt(n[f, c])) / language.ALPHA + language.L2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(language.ROUNDS):
        for k in order.permutation(np.arange(len(examples))):
            x = {**examples[k], "offset": 1.0}
            w = {(f, c): weight(f, c) for f in x for c in range(classes)}
            s = [sum(x[f] * w[f, c] for f in x) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(classes):
                error = e[c] / sum(e) - (c == langs[k])
                for f, v in x.items():
                    g = v * error
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / language.ALPHA * w[f, c]
                    n[f, c] += g * g
    return weight


def test_fit_and_prediction_equal_plain_ftrl():
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog and the hat", "das ist ein haus", "le chat est sur la table", "la maison et le chien"] * 3
    langs = np.array([0, 1, 0, 1, 2, 2] * 3)
    df = Counter(f for t in texts for f in set(plain_ngrams(t)))
    idf = np.log((1 + len(texts)) / (1 + np.array([df[f] for f in range(language.FEATURES)]))) + 1
    w, b, t = language.fit([language.term_frequencies(x) for x in texts], langs, 3, idf)
    examples = []
    for text in texts:
        grams = Counter(plain_ngrams(text))
        examples.append({f: c / sum(grams.values()) * idf[f] * language.SCALE for f, c in grams.items()})
    weight = plain_ftrl(examples, langs, 3)
    for c in range(3):
        assert b[c] == pytest.approx(weight("offset", c), abs=1e-9)
        for f in {f for x in examples for f in x}:
            assert w[f, c] == pytest.approx(weight(f, c) * idf[f] * language.SCALE, rel=1e-6, abs=1e-9)
    assert (w != 0).sum() < w.size / 50  # the penalty leaves most weights at zero
    for text in ("the house", "und das", "sur la"):
        grams = plain_ngrams(text)
        s = [(sum(w[f, c] for f in grams) / len(grams) + b[c]) / t for c in range(3)]
        said, sure = language.predicted(text, (["en", "de", "fr"], w, b, t))
        best = int(np.argmax(s))
        assert said == ["en", "de", "fr"][best] and sure == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s))


def test_words_are_told_apart():
    a, b = word_hashes("The cat\tsat  on"), word_hashes("the CAT sat on ")
    assert (a == b).all() and len(set(a.tolist())) == 4
    assert len(word_hashes("")) == len(word_hashes(" \n\x0b")) == 0


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    awkward = spark.createDataFrame([(10**6 + i, t, lang, s, 1) for i, t, lang, s in awkward_rows()], docs.schema)
    kept = [docs.unionByName(awkward)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns, name
        kept.append(out.cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    und = {r.doc_id for r in kept[0].collect() if not any(c.isalpha() for c in r.text or "")}
    assert und and not und & ids[1] and {r.doc_id for r in docs.select("doc_id").collect()} <= ids[1]
    from .test_near import plain_components

    # Rows that repeat an id and its text are copies, those that repeat it with another text are not.
    want = {i for i, _, root in plain_components([(r.doc_id, r.text) for r in kept[1].collect()]) if i == root}
    assert ids[2] == want and kept[2].count() == len(want)
    assert ids[3] <= ids[2] and kept[3].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    assert all(texts[r.doc_id] == r.text for r in kept[3].collect())
    # The pieces of the last stage, held against the library.
    library = Tokenizer.from_file(registry.tokenizer_file())
    took, covered = Counter(r.doc_id for r in kept[3].collect()), defaultdict(list)
    for p in corpus_pipeline.packed(spark, kept[3], SF).collect():
        covered[p.doc_id].append(p)
    assert set(covered) == ids[3]
    for i, pieces in covered.items():
        want = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert sum(p.length for p in pieces) == len(want) * took[i] and {p.doc_tokens for p in pieces} == {len(want)}
        assert all(p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in pieces)
        assert Counter(k for p in pieces for k in range(p.start, p.start + p.length)) == Counter({k: took[i] for k in range(len(want))})
    empty = kept[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.collect() == []
        empty = kept[0].limit(0)


def test_pipeline_keeps_rows_without_ids_and_with_shared_ids(spark):
    import corpus_pipeline

    from .fixtures import words

    rng = random.Random(4)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, component_id long"
    rows = [(None, a), (None, b), (None, a + " z"), (5, c), (5, d), (6, d), (5, c), (7, "12 34 56"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1, "x", 9) for k, (i, t) in enumerate(rows)], schema)
    told = corpus_pipeline.identified(spark, docs, SF)
    assert told.columns == docs.columns and told.count() == 7
    kept = corpus_pipeline.distinct_texts(spark, told, SF)
    assert kept.columns == docs.columns
    assert sorted(r.text[:9] for r in kept.collect()) == sorted(t[:9] for t in (a, b, c, d))
    mix = corpus_pipeline.mixed(spark, kept, SF)
    assert mix.columns == docs.columns and 0 < mix.count() <= 8 and {r.text for r in mix.collect()} <= {a, a + " z", b, c, d}
    assert corpus_pipeline.packed(spark, mix, SF).count() > 0
