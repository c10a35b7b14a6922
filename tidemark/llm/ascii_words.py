"""Words of UTF-8 texts made of digits, Latin letters (A-Z lower-cased) and all characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same words in SQL, once A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20

#: A byte that belongs to no word becomes a space. All bytes of a character beyond ASCII are over 0x7F.
FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: Column) -> Column:
    """The words as an array; null for a null text."""
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(PATTERN), F.lit(0))


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at once unless one word is longer."""
    if len(text) <= STRETCH:
        yield text.translate(FOLD).split()
        return
    begin = 0
    while begin < len(text):
        part, tail = text[begin : begin + STRETCH].translate(FOLD), b""
        begin += STRETCH
        while part[-1:] != b" " and begin < len(text):  # the last word goes on
            more = text[begin : begin + STRETCH].translate(FOLD)
            cut = more.find(b" ") + 1 or len(more)
            tail += more[:cut]
            begin += cut
            if more[cut - 1 : cut] == b" ":
                break
        yield (part + tail).split()


def word_numbers(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The number of every word in order; 0 for words that have none."""
    parts = [np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words)) for words in stretches(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)
