"""Words of long texts, a piece at a time: tasks never hold a list of all words of a very long text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: ASCII blanks, which part words: what bytes.split() splits at.
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def utf8(text: str | None, lower: bool = False) -> bytes:
    """The text in UTF-8 (null: empty); lower: A-Z become a-z, nothing else changes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.lower() if lower else data


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Lists of consecutive words, stretches without ASCII blanks, of about `size` bytes each."""
    at = 0
    while at < len(data):
        cut = BLANK.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        if words := data[at:end].split():
            yield words
        at = end
