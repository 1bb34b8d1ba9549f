import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamline.llm import packing
from loamline.llm.token_counts import count, counter, fitting, prefix_counts, token_counts

from .fixtures import awkward_rows, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "a", "the", "é", "日本", "1", "23", "!", "...", "<|endoftext|>", "\x1c", "I'll", "<|end", "\xa0", "ththth"]


def test_every_prefix_equals_the_library():
    rng, library, own = random.Random(1), Tokenizer.from_file(PATH), counter(PATH)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(1, len(text) + 1)]
        table, limit = own.table(text), rng.randrange(7)
        assert own.pairs.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert prefix_counts(table).tolist() == want
        assert [count(table, p) for p in range(1, len(text) + 2)] == want + want[-1:] or not text
        assert fitting(table, limit) == max([p + 1 for p, n in enumerate(want) if n <= limit], default=0)


def test_counts_of_whole_texts(spark):
    rows, library = awkward_rows(), Tokenizer.from_file(PATH)
    got = token_counts(frame(spark, rows), PATH, 100, tables=True).collect()
    want = []
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 100))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    texts = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        counted = lambda k, text=texts[r.doc_id]: len(library.encode(text[:k], add_special_tokens=False).ids)
        assert counted(r.fit_chars) <= 100 and (r.fit_chars == len(texts[r.doc_id]) or counted(r.fit_chars + 1) > 100)
        assert len(prefix_counts(bytes(r.prefix_counts))) == len(texts[r.doc_id])
    assert token_counts(frame(spark, []), PATH, 100, tables=True).collect() == []


LONG = {"spaces": "a" + " " * 5_000_000 + "b", "lines": "\n" * 5_000_000, "tabs": "x \t" * 3000 + "\t" * 6000 + "<|endoftext|>" + " " * 6000 + "'s", "letters": "ab" * 500_000, "mixed": " \u3000\xa0" * 5000 + "\x1c" + " " * 4096}


@pytest.mark.parametrize("name", LONG)
def test_very_long_runs_are_whole(name):
    text, own = LONG[name], counter(PATH)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert own.pairs.ids(text).tolist() == want
    every = prefix_counts(own.table(text))
    assert len(every) == len(text) and every[-1] == len(want)


def check_packing(rows, pieces, window):
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(want)
    for i, copies in want.items():
        ids = copies[0]
        assert all(c == ids for c in copies)
        covered = np.zeros(len(ids), int)
        for p in by_doc[i]:
            own = np.array(ids[p.start : p.start + p.length], "<u4")
            assert len(own) == p.length > 0 and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
            covered[p.start : p.start + p.length] += 1
        assert (covered == len(copies)).all()
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_places_every_id_once(spark):
    rows = awkward_rows()
    for window in (1024, 64):
        assert check_packing(rows, packing.pack(frame(spark, rows), PATH, window=window).collect(), window) == 0
    assert packing.pack(frame(spark, []), PATH).collect() == []


def test_sequences_have_the_ids_of_all_their_pieces(spark, monkeypatch):
    """The content of every sequence, also of those that one document fills."""
    monkeypatch.setattr(packing, "BATCH_BYTES", 1000)
    rows, library = awkward_rows(), Tokenizer.from_file(PATH)
    want = {i: {(*library.encode(t or "", add_special_tokens=False).ids, 0) for k, t, *_ in rows if k == i} for i, *_ in rows}
    pieces = packing.pack(frame(spark, rows), PATH, window=64).collect()
    assert any(p.length == 64 for p in pieces)
    for p in pieces:
        own = tuple(np.frombuffer(p.ids, "<u4").tolist())
        assert len(own) == p.length and any(own == ids[p.start : p.start + p.length] for ids in want[p.doc_id])


def test_very_long_texts_are_packed_and_counted(spark):
    rows = [(1, LONG["spaces"], "en", "s0"), (2, LONG["tabs"], "en", "s0"), (3, "word " * 1_000_000, "en", "s0")]
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t, *_ in rows}
    pieces = packing.pack(frame(spark, rows), PATH).collect()
    for i, ids in want.items():
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        ids = np.array([*ids, 0], "<u4")
        assert [p[0] for p in own] == np.cumsum([0, *(p[1] for p in own)])[:-1].tolist() and sum(p[1] for p in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in own)
    assert {r.doc_id: r.n_tokens for r in token_counts(frame(spark, rows), PATH, 512).collect()} == {i: len(ids) for i, ids in want.items()}


def test_least_squares_fills_windows_from_the_histogram():
    histogram = np.zeros(64, np.int64)
    histogram[[10, 54, 20, 22]] = 500, 500, 300, 600
    combos = packing.combinations(histogram, 64)
    assert [10, 54] in combos[:, 1:].tolist() and [20, 22, 22] in combos.tolist()
    times = packing.repeats(combos, packing.non_negative(combos, histogram), histogram)
    used = np.zeros(64, np.int64)
    for row, n in zip(combos, times, strict=True):
        for v in row[row > 0]:
            used[v] += n
    assert (used <= histogram).all() and used.sum() >= 0.98 * histogram.sum()
