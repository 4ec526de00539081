"""Terms of texts: runs of bytes that are no separators, with A-Z alone in lower case."""

from __future__ import annotations

import string
from collections.abc import Callable

_LETTERS = string.ascii_letters.encode()
_DIGITS = string.digits.encode()


def splitter(digits: bool) -> Callable[[bytes | None], list[bytes]]:
    """A function from a UTF-8 text to its terms: ASCII letters, all other code points from 128 and, if wanted, digits.

    One table lookup for each byte, then a split at blanks: no code point from
    128 has a byte below 128, so UTF-8 need not be decoded. Null: no terms.
    """
    kept = set(_LETTERS + (_DIGITS if digits else b"")) | set(range(128, 256))
    table = bytes(bytes([b]).lower()[0] if b in kept else 32 for b in range(256))

    def split(text: bytes | None) -> list[bytes]:
        return text.translate(table).split() if text else []

    return split
