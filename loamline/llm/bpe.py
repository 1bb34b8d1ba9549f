"""Byte-level BPE files of ``tokenizers``, read into ``tiktoken`` for whole-text encoding.

In these files an entry's id is also the rank of the merge that makes it, so both
libraries give the same ids; the tests hold them against each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that ``\s`` of that pattern means (Unicode's White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut out before the pattern sees them, which backtracks over them.
LONG_RUN = 4096
_LONG = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves, the others for code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BytePairs:
    """``ids``, and the bytes behind them, as ``Tokenizer.encode(add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.ranks = {bytes(byte[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.sizes = np.zeros(max([*self.ranks.values(), *self.special.values()]) + 1, np.int64)
        for t, i in [*self.ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.sizes[i] = len(t)

    def ids(self, text: str) -> np.ndarray:
        """Token ids (uint32) of a whole text; special strings in it are special tokens.

        The pattern makes all but the last character of a run of white space one pre-token,
        and the whole run if it ends the text: long runs are cut there, which is exact.
        """
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        return np.concatenate([self.piece(part) if run else self.encoding.encode_to_numpy(part, allowed_special="all") for part, run in self.cut_at_runs(text)])

    def piece(self, piece: str) -> np.ndarray:
        """Token ids of one pre-token."""
        return np.array(self.encoding._encode_single_piece(piece.encode("utf-8")), np.uint32)

    def cut_at_runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """The parts of a text before, in and after its long runs of white space; true for a run."""
        at = 0
        for found in _LONG.finditer(text):
            end = found.end()
            if end < len(text) and not any(text.startswith(mark, end) for mark in self.special):
                end -= 1
            if found.start() > at:
                yield text[at : found.start()], False
            yield text[found.start() : end], True
            at = end
        if at < len(text):
            yield text[at:], False


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """One for each Python worker, which serves all its tasks."""
    return BytePairs(path)
