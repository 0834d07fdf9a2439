"""Regex helpers that give one pattern the same meaning on every JVM.

Python-style ``\\b`` and ``\\d`` are Unicode aware while Java's depend on flags and JDK
version, so both are spelled out as explicit classes.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text libraries see it, separators \x1c-\x1f included.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"

_WORD = r"[\p{L}\p{N}_]"
_BEFORE_WORD = f"(?<!{_WORD})"
_AFTER_WORD = f"(?!{_WORD})"


def jvm(pattern: str, space: str = " ") -> str:
    """Spell ``\\b``, ``\\d`` and ``\\s`` out; ``space`` is what ``\\s`` may be.

    Detectors run on lines whose whitespace is already collapsed, hence the default.
    """
    spelled = re.sub(r"\\b(?=[A-Za-z(\[\\])", lambda _: _BEFORE_WORD, pattern)
    spelled = spelled.replace(r"\b", _AFTER_WORD)
    in_class = space[1:-1] if space.startswith("[") else space
    spelled = re.sub(
        r"\[([^\]]*)\\s\]", lambda m: f"[{m.group(1)}{in_class}]", spelled
    )
    return spelled.replace(r"\d", r"\p{Nd}").replace(r"\s", space)


def hit(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(flags + jvm(pattern))


def grab(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match of ``pattern``, the empty string when there is none."""
    return F.regexp_extract(text, flags + jvm(pattern), group)


def some(text: Column) -> Column:
    """Null for the empty string; cheap only on a stored column."""
    return F.when(text != "", text)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def starts_with_any(text: Column, words: tuple[str, ...]) -> Column:
    test = text.startswith(words[0])
    for word in words[1:]:
        test = test | text.startswith(word)
    return test


def literal_alternation(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(word) for word in words)
