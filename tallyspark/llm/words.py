"""Words of UTF-8 texts as bytes, in blocks of bounded size, and texts of Arrow batches."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa

SLICE = 1 << 20  # bytes of a text split into words at once


def table(kept: str) -> bytes:
    """A translation table: A-Z lower-cased, ``kept`` ASCII characters and all bytes above ASCII as they are, else a space."""
    out = bytearray(range(256))
    for code in range(128):
        low = chr(code).lower()
        out[code] = ord(low) if low in kept else 32
    return bytes(out)


LETTERS = table(string.ascii_lowercase)
LETTERS_DIGITS = table(string.ascii_lowercase + string.digits)


def words(data: bytes, kept: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, a list for about every ``size`` bytes; a word is never cut."""
    clean, at = data.translate(kept), 0
    while at < len(clean):
        end = at + size
        if end < len(clean):
            cut = clean.rfind(b" ", at, end)
            cut = clean.find(b" ", end) if cut < 0 else cut
            end = len(clean) if cut < 0 else cut + 1
        yield clean[at:end].split()
        at = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""
