"""Text expressions with the character classes and rounding of Python strings and floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space, word characters and digits, and
# the line boundaries of str.splitlines(). Java's own \s, \w and \d differ on non-ASCII text.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# The same white space one by one, the most frequent first, for trims without a pattern.
SPACES = " \t\n" + "".join(
    chr(c) for c in (*range(0xB, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
    r"\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}"
    r"\x{2780}-\x{2788}\x{278a}-\x{2792}\x{1369}-\x{1371}\x{19da}"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Any boundary but the newline.
OTHER_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = rf"[A-Za-z_][{WORD}]*|[^{SPACE}{WORD}]"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside an expression."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def lines(text: Column) -> Column:
    """Lines between newline characters; a trailing newline leaves an empty last line."""
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    return count_of(text, "\n") + 1


def boundary_lines(text: Column) -> Column:
    """Lines at every Unicode line boundary; a trailing boundary adds no line.

    Most texts hold newlines alone and are split without a pattern.
    """
    parts = F.when(text.rlike(OTHER_LINE_END), F.split(text, LINE_END)).otherwise(F.split(text, "\n"))
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    cut = F.length(text) - F.length(F.replace(text, F.lit(piece)))
    return (cut / len(piece)).cast("int") if len(piece) > 1 else cut


def count_chars(text: Column, chars: str) -> Column:
    """Occurrences of any of the characters, in one pass."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+"))


def digit_words(text: Column) -> Column:
    """Words between white space made only of digits."""
    return F.regexp_count(text, F.lit(rf"(?<![^{SPACE}])[{DIGIT}]+(?![^{SPACE}])"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round on the exact binary value of a double, ties to even, as Python's round() does.

    The sign of x - midpoint is computed without error by splitting x in two halves
    (Dekker's splitting), because x * 10**digits would itself be rounded.
    """
    scale = 10.0**digits
    low = F.floor(x * scale)
    big = x * 134217729.0
    high_half = big - (big - x)
    error = (high_half * (2 * scale) - (low * 2 + 1)) + (x - high_half) * (2 * scale)
    up = (error > 0) | ((error == 0) & (low % 2 != 0))
    return F.when(up, (low + 1) / scale).otherwise(low / scale)
