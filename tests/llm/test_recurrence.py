from tokenizers import Tokenizer

from loamline.llm.bpe import BytePairs
from loamline.llm.token_counts import PrefixCounter, prefix_counts, token_counts

from .fixtures import awkward_rows, frame
from .test_tokens import PATH


def test_counts_come_from_the_recurrence_and_take_long_runs(spark):
    library = Tokenizer.from_file(PATH)
    rows = [*awkward_rows(), (900, "a" + " " * 1_000_000 + "b", "en", "s0")]
    want = sorted((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts(frame(spark, rows), PATH, 100).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want


def test_whole_texts_are_not_encoded(monkeypatch):
    own = PrefixCounter(BytePairs(PATH))
    monkeypatch.setattr(BytePairs, "ids", None)
    text = "The cat's  hat<|endoftext|> \u65e5\u672c 123"
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    every = prefix_counts(own.table(text)).tolist()
    assert len(every) == len(text) and every[-1] == len(ids)
