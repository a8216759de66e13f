"""Python twins of text functions, for code that runs inside UDFs."""

from __future__ import annotations

import re
import unicodedata

from .text import TOKEN

_WORD, _JOINER = re.compile(TOKEN), re.compile("[._-]")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def tokens(text: str) -> list[str]:
    out = []
    for word in _WORD.findall(text.lower() if text.isascii() else fold(text)):
        out.append(word)
        if not word.isalnum():
            out += [p for p in _JOINER.split(word) if len(p) > 1]
    return out
