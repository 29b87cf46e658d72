"""Splitting text into the pieces that byte-level byte-pair merging works on."""

from __future__ import annotations

import re

import regex

# fixed values: the split pattern of the vocabulary's pre-tokenizer, and its special token
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

_whole = regex.compile(PATTERN)
# The same for texts of these characters only, on which \p{L} and \p{N} are [^\W\d_] and \d; twice as fast.
_plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_not_plain = re.compile("[^\t\n\r\x20-\x7eÀ-ɏЀ-ҁ‐-‧]")


def pieces(text: str) -> list[str]:
    """The pieces of a text without special tokens; together they are the text."""
    return (_whole if _not_plain.search(text) else _plain).findall(text)
