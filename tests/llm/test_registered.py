"""The registered queries over their whole tables, against their contracts and plain definitions."""

import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from loamline.llm import media, registry

from .fixtures import SF
from .test_native import plain_targets
from .test_near import plain_components, plain_vectors
from .test_tokens import PATH

COLUMNS = {
    "op1_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_license_scans": ["doc_id", "digest", "license"],
    "op4_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_media_columns": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_lm_scoring": ["doc_id"],
}


@pytest.fixture(scope="module")
def rows(spark):
    found = {name: build(spark, SF) for name, build in registry.queries().items()}
    assert {name: df.columns[: len(COLUMNS[name])] for name, df in found.items()} == COLUMNS
    return {name: df.collect() for name, df in found.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_row_is_there_once(spark, rows, docs):
    for name in COLUMNS:
        if name not in ("op1_url_filters", "op2_packing", "op8_embedding_near_dedup"):
            assert sorted(r.doc_id for r in rows[name]) == sorted(docs), name
    assert sorted(r.page_id for r in rows["op1_url_filters"]) == sorted(r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect())


def test_tokens_and_pieces(rows, docs):
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(r.text or "", add_special_tokens=False).ids for i, r in docs.items()}
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id].text or "").encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 512) for r in rows["op5_token_counts"])
    covered, sequences = defaultdict(int), defaultdict(list)
    for p in rows["op2_packing"]:
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.doc_tokens == len(ids[p.doc_id]) + 1
    assert covered == {i: len(x) + 1 for i, x in ids.items()}
    for parts in sequences.values():
        size = sum(n for _, n in parts)
        assert size <= 1024 and sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))


def test_joins(spark, rows, docs):
    assert sorted(tuple(r) for r in rows["op4_ngram_jaccard_join"]) == plain_components([(i, r.text) for i, r in docs.items()])
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in rows["op8_embedding_near_dedup"]) == plain_vectors(vectors)


def test_media_and_mix(rows, docs):
    for r in rows["op6_media_columns"]:
        content = media.payload(docs[r.doc_id].text)
        assert (r.payload_bytes, r.tail_crc32) == (len(content), zlib.crc32(content[-64:])) and media.decoded_batch([bytes(r.pcm)])[0][0] == 16000
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows["op7_mixing"]:
        source = docs[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
        assert r.taken <= 2 * r.size
    want = plain_targets(sizes, 1.5, 2.0, (5, 2, 1))
    for r in rows["op7_mixing"]:
        assert (r.source_size, r.target) == (sizes[docs[r.doc_id].source], pytest.approx(want[docs[r.doc_id].source]))
    assert all(abs(taken[s] - want[s]) < largest[s] for s in sizes)


def test_languages(rows, docs):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows["op9_language_id"])
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows["op9_language_id"] if r.held_out and docs[r.doc_id].lang]
    assert sum(held) >= 0.9 * len(held)
