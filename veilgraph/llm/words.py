"""Words of texts as bytes: runs of letters, of digits too if asked for, and of whatever is not ASCII."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def splitter(digits: bool):
    """A function from UTF-8 bytes (or None) to their words, A-Z in lower case.

    Every byte of a character beyond ASCII is beyond ASCII itself, so bytes split as characters do.
    """
    kept = lambda b: b > 127 or chr(b).isalpha() or (digits and chr(b).isdigit())
    table = bytes((b if kept(b) else 32) for b in range(256)).lower()
    return lambda raw: raw.translate(table).split() if raw else []


def sql_words(column: str, digits: bool) -> str:
    """DuckDB's list of the same words."""
    gaps = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F" if digits else r"\x00-\x40\x5B-\x60\x7B-\x7F"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^{gaps}]+')"
