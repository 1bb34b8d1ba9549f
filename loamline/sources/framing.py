"""Cutting journal files into records and records into tokens.

A record is a pair of braces with what is between them; braces in double quotes do not
count.  In quotes a backslash takes the character after it along, so that ``\\"`` does not end
them (``escapes=False`` reads it as any other character).  This is a sequential scan with
state, the one thing here that is no Column expression; everything after the tokens is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

BOM = b"\xef\xbb\xbf"
HEADER = b"1CV8LOG"
_MARK = {True: re.compile(rb'\\[\x00-\xff]|["{}]'), False: re.compile(rb'["{}]')}
_TOKEN = {True: re.compile(r'(?s)\\.|["{},]'), False: re.compile(r'["{},]')}


def body_start(head: bytes) -> int:
    """Bytes before the first record: the header line and the line with the infobase's GUID."""
    at = len(BOM) if head.startswith(BOM) else 0
    if not head.startswith(HEADER, at):
        raise ValueError("not an event journal")
    for _ in range(2):
        end = head.find(b"\n", at)
        at = len(head) if end < 0 else end + 1
    return at


def records(data: bytes, start: int = 0, escapes: bool = True) -> Iterator[tuple[int, bytes]]:
    """(end, record) of every complete record from ``start``; an unfinished last one is left."""
    depth, begin, quoted = 0, start, False
    for found in _MARK[escapes].finditer(data, start):
        mark = found[0]
        if len(mark) == 2:
            if quoted:
                continue
            mark = mark[1:]  # outside quotes a backslash is a character like any other
        if mark == b'"':
            # A doubled quote closes and opens again, so it changes nothing.
            quoted = not quoted and depth > 0
        elif quoted:
            continue
        elif mark == b"{":
            if depth == 0:
                begin = found.end() - 1
            depth += 1
        elif mark == b"}" and depth:
            depth -= 1
            if depth == 0:
                yield found.end(), data[begin : found.end()]


def tokens(text: str, keep_empty: bool = True, escapes: bool = True) -> list[str]:
    """The parts of ``text`` between commas outside quotes and braces, trimmed.

    ``keep_empty=False`` leaves out empty parts, which shifts those after them.
    """
    out, depth, begin, quoted = [], 0, 0, False
    for found in _TOKEN[escapes].finditer(text):
        mark = found[0]
        if len(mark) == 2:
            if quoted:
                continue
            mark = mark[1]
        if mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark == ",":
            if depth == 0:
                out.append(text[begin : found.end() - 1].strip())
                begin = found.end()
        elif mark in "{}":
            depth += 1 if mark == "{" else -1
    out.append(text[begin:].strip())
    return out if keep_empty else [x for x in out if x]


def inner(text: str) -> str:
    text = text.strip()
    return text[1:-1].strip() if text.startswith("{") and text.endswith("}") else text


def listed_items(field: str, escapes: bool = True) -> list[tuple[str, str]]:
    """(type, value) of the items of a ``{P,{n,item,...}}`` field; empty for other fields."""
    parts = tokens(inner(field), escapes=escapes)
    if len(parts) < 2 or parts[0].strip('"') != "P":
        return []
    out = []
    for item in tokens(inner(parts[1]), escapes=escapes)[1:]:
        kind, _, value = inner(item).partition(",")
        out.append((kind.strip().strip('"'), value.strip()))
    return out


def record_row(record: bytes, keep_empty: bool = True, escapes: bool = True) -> tuple[list[str], list[tuple[str, str]]] | None:
    """Tokens and list items of a record; null for an empty one."""
    text = inner(record.decode("utf-8", "replace"))
    if not text:
        return None
    parts = tokens(text, keep_empty, escapes)
    return parts, listed_items(parts[11], escapes) if len(parts) > 11 else []
