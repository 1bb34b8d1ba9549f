"""Rows without ids, and tables in which every value is null: each operator still gives every row."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamline.llm import language, licenses, lm_scoring, media, mixing, near_vectors, ngram_join, packing, token_counts

from .fixtures import awkward_rows, frame, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "packing": lambda d: packing.pack(d, PATH),
    "licenses": licenses.scan,
    "ngrams": ngram_join.ngram_components,
    "tokens": lambda d: token_counts.token_counts(d, PATH, 512, tables=True),
    "media": media.media_columns,
    "mixing": mixing.mix,
    "language": language.identify,
    "lm": lambda d: lm_scoring.score(d, d.where("doc_id % 2 = 0").select("doc_id")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_ids(spark, name):
    import random

    rows = awkward_rows(plain=8)
    rows += [(None, rows[0][1], "en", "s0"), (None, None, None, None), (None, words(random.Random(1), 2000), "de", "s1")]
    got = OPERATORS[name](frame(spark, rows))
    assert got.where("doc_id is null").count() >= 3
    assert got.count() >= len(rows)
    if name == "ngrams":
        same = got.where(F.col("doc_id").isNull() & F.col("component_id").isNotNull()).collect()
        assert [r.component_id for r in same] == [0]
    nothing = OPERATORS[name](frame(spark, [(None, None, None, None)] * 2))
    assert nothing.count() == 2


def test_vectors_without_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, None), (5, [1.0, 0.01], 1)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(4, 1, 4, True), (5, 1, 4, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)] * 2
