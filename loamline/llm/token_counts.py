"""Token counts: prefix dynamic programming over byte-pair encodings.

In a byte-pair encoding every leading run of tokens is itself the encoding of the text
it spells.  So the encoding of a prefix of ``i`` bytes ends in one token ``t``, and what
stands before it is the encoding of the prefix without ``t``::

    count[i] = count[i - len(t)] + 1

where ``t`` is the one vocabulary entry ending at ``i`` that follows the last token of
the shorter prefix without a merge across their border.  The recurrence runs over each
pre-token and gives the count of every prefix of it.  Two kinds of prefixes are split by
the pre-tokenizer in another way than the whole text: one that ends within a run of white
space (there the run so far is one pre-token), and one that cuts a contraction of three
characters.  Both are solved with the recurrence too.

The pre-tokenizer always cuts where white space follows something else.  The chunks
between these places (white space, then what is none) do not depend on each other, so a
text's table is joined from the tables of its chunks, most of which are remembered.  A
table holds the change of the count at every character.  It is stored, and counts,
truncation ("how much fits in n tokens") and budget questions ("has this prefix more than
n tokens") are answered from it; no text is encoded a second time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import PATTERN, WHITE, BytePairs, byte_pairs
from .common import Stash

_PIECES = regex.compile(PATTERN)
_CHUNKS = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_BLANK = regex.compile(f"[{WHITE}]")
#: The pattern's contractions of three characters.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Chunks of up to so many characters are remembered, and how many of them by a worker.
SHORT, REMEMBERED = 64, 1_000_000
#: Bits of an id, and what stands for the token before the first; above all ids.
SHIFT = 24
START = (1 << SHIFT) - 1


class PrefixCounter:
    """Exact token counts of all prefixes for one byte-level BPE file."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        #: What an entry's id stands for, and an automaton that finds all entries in a run of bytes.
        self.spelled = {i: token for token, i in pairs.ranks.items()}
        self.entries = ahocorasick.Automaton()
        for token, i in pairs.ranks.items():
            self.entries.add_word(token.decode("latin-1"), (len(token), i))
        self.entries.make_automaton()
        #: Whether an entry keeps its form after another, by both ids; the first id is ``START`` at the start.
        self.follows: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.special = sorted(pairs.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _stable(self, key: int) -> bool:
        """Whether a token keeps its form after another; the answer is remembered."""
        if len(self.follows) > REMEMBERED:
            self.follows.clear()
        before, token = key >> SHIFT, key & (1 << SHIFT) - 1
        ids = [token] if before == START else [before, token]
        known = self.follows[key] = self.pairs.encoding._encode_single_piece(b"".join(self.spelled[i] for i in ids)) == ids
        return known

    def _piece(self, piece: str) -> list[int]:
        """The recurrence over one pre-token: entry k is of its first k + 1 characters."""
        raw = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        follows, done = self.follows, 0
        count, last = [0] * (len(raw) + 1), [START << SHIFT] * (len(raw) + 1)
        # All entries that end at a place come one after the other; one of them is the last token there.
        for end, (size, token) in self.entries.iter(raw):
            if end >= done:
                start = end + 1 - size
                try:
                    fits = follows[last[start] + token]
                except KeyError:
                    fits = self._stable(last[start] + token)
                if fits:
                    done = end + 1
                    count[done] = count[start] + 1
                    last[done] = token << SHIFT
        if len(raw) == len(piece):
            return count[1:]
        return [count[i] for i in range(1, len(raw) + 1) if i == len(raw) or ord(raw[i]) & 0xC0 != 0x80]

    def counted(self, text: str) -> list[int]:
        """Entry k: the tokens of the first k + 1 characters of a text without special strings."""
        # What follows one blank at most is one pre-token if it is all letters; so is a last sign behind them.
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return self._piece(text)
        if word[:-1].isalpha() and not word[-1].isalnum() and not _BLANK.match(word[-1]):
            own, last = self._piece(text[:-1]), self._piece(word[-1])[0]
            own.append(own[-1] + last)
            return own
        pieces = _PIECES.findall(text)
        out, done, first = [], 0, None
        for k, piece in enumerate(pieces):
            after = pieces[k + 1][0] if k + 1 < len(pieces) else ""
            if after and _BLANK.match(after) and _BLANK.match(piece[-1]):
                # The run of white space goes on: a prefix that ends behind its next character is one pre-token.
                *own, joined = self._piece(piece + after)
            else:
                own, joined = self._piece(piece), None
            end = done + own[-1]
            if piece in CONTRACTIONS:
                own[1] = self._piece("'")[0] + self._piece(piece[1])[0]
            own = [done + n for n in own]
            if first is not None:
                own[0] = first
            out += own
            first, done = None if joined is None else done + joined, end
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Changes of the count at every character of a chunk, a byte each; empty if one needs more."""
        if (known := self.older.get(chunk)) is None:
            out, before = [], 0
            for n in self.counted(chunk):
                out.append(n - before)
                before = n
            known = struct.pack(f"{len(out)}b", *out) if len(out) < 32 or (max(out) < 128 and min(out) > -129) else b""
        if len(chunk) <= SHORT:
            if len(self.chunks) >= REMEMBERED // 2:
                # The half that was asked for last stays.
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = known
        return known

    def table(self, text: str) -> bytes:
        """The text's table: the bytes of an entry (1 or 4), then the change of the count at every character."""
        if not self.special or not self.marks.search(text):
            chunks = _CHUNKS.findall(text)
            parts = [self.chunks.get(c) or self._chunk(c) for c in chunks]
            if all(parts):
                return b"\x01" + b"".join(parts)
            steps = [np.diff(np.array(self.counted(c), np.int64), prepend=0) for c in chunks]
        else:
            steps, before = [], ""
            for k, part in enumerate(self.marks.split(text)):
                if k % 2 == 0:
                    chunks = _CHUNKS.findall(part)
                    steps += [np.diff(np.array(self.counted(c), np.int64), prepend=0) for c in chunks]
                    before = chunks[-1] if chunks else ""
                else:
                    # A special string that is cut is ordinary text after what stands before it; whole it is one token.
                    cut = self.counted(before + part)[len(before) : -1]
                    done = self.counted(before)[-1] if before else 0
                    steps.append(np.diff(np.array([*cut, done + 1], np.int64), prepend=done))
                    before = ""
        every = np.concatenate([np.empty(0, np.int64), *steps])
        if np.abs(every).max(initial=0) < 128:
            return b"\x01" + every.astype(np.int8).tobytes()
        return b"\x04" + every.astype("<i4").tobytes()


def prefix_counts(table: bytes) -> np.ndarray:
    """Entry k: the exact number of tokens of a text's first k + 1 characters, from its stored table."""
    return np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)


def count(table: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    every = prefix_counts(table)
    chars = min(chars, len(every))
    return int(every[chars - 1]) if chars > 0 else 0


def fitting(table: bytes, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens."""
    fits = np.flatnonzero(prefix_counts(table) <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    return PrefixCounter(byte_pairs(path))


def prefix_tables(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, prefix_counts`` of every row: the exact token count at every prefix, see ``PrefixCounter.table``.

    Null and empty texts have no bytes and a table without entries; a text of any length is
    solved whole, with about 60 bytes of memory a byte of its longest pre-token.  Repeated
    rows give repeated results, a null id stays null; other columns are not read, whatever
    their names.  One narrow pass without a shuffle; a lost executor's tasks are run again.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = pa.array([len(x.encode("utf-8")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_bytes": sizes, "prefix_counts": pa.array([of.table(x) for x in texts], pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(solve, f"id {kind}, n_bytes long, prefix_counts binary")


def token_counts(docs: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars`` of every row, each read off its stored table.

    ``fit_chars`` is the length in characters of the longest prefix with at most ``limit``
    tokens.  With ``tables`` the table itself follows, ``prefix_counts``.  The tables are
    stored first, so that a question asked later finds them; what holds for awkward rows is
    said at ``prefix_tables``.  An empty table gives an empty result.
    """
    stored = Stash(docs.sparkSession, "tokens").save(prefix_tables(docs, path, id_col=id_col, text_col=text_col), "tables")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, fit = [], []
            for cell in batch.column("prefix_counts"):
                every = prefix_counts(cell.as_py())
                tokens.append(int(every[-1]) if len(every) else 0)
                fits = np.flatnonzero(every <= limit)
                fit.append(int(fits[-1]) + 1 if len(fits) else 0)
            made = {"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_()), "fit_chars": pa.array(fit, pa.int64())}
            yield pa.RecordBatch.from_pydict(made | ({"prefix_counts": batch.column("prefix_counts")} if tables else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts binary" * tables
    return stored.mapInArrow(answer, schema).withColumnRenamed("id", id_col)
