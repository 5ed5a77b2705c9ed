"""Text functions: normalisation, tokens, shingles, lines, comparison. Column in, Column out; all inside the JVM.

Beside each pattern stands what makes it equal in RE2 dialects: no look-around, explicit classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Python string method sees it, without the line feed; and with it.
BLANK = r"\t\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\n" + BLANK
#: Code tokens (identifiers, digit runs, other single characters), and the ASCII variant.
TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^" + SPACE + "]"
ASCII_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s]"
#: Fixed value: the separators at which Python splits lines.
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WIDTH = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A column that a lambda refers to may be inlined into it by the optimizer and computed anew for each element; a lambda
    variable is bound to the value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_newlines(text: Column) -> Column:
    """CRLF and lone CR as LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_code(text: Column) -> Column:
    """Newlines folded, line ends stripped, the whole stripped."""
    return strip(F.regexp_replace(fold_newlines(text), f"[{BLANK}]+\n", "\n"))


def code_tokens(text: Column) -> Column:
    """Tokens of the text. Normalising first changes white space only, so it can be left out."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def token_count(text: Column) -> Column:
    """Number of code tokens, without making the array.

    On ASCII text without separator controls the ASCII pattern finds the same tokens four times as fast.
    """
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike(r"[\x1c-\x1f]")
    return F.when(plain, F.regexp_count(text, F.lit(ASCII_TOKEN))).otherwise(F.regexp_count(text, F.lit(TOKEN)))


def ascii_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ASCII_TOKEN))


def _shingles(tokens: Column, width: int, digest: Callable[[Column], Column]) -> Column:
    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: digest(F.array_join(F.slice(t, i, width), "\0")))
        return F.array_distinct(F.when(F.size(t) >= width, runs).otherwise(F.transform(t, digest)))

    return let(tokens, of)


def shingle_hashes(tokens: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit hashes of runs of ``width`` tokens; of single tokens if there are fewer than ``width``."""
    return _shingles(tokens, width, lambda s: F.xxhash64(s))


def shingle_digests(tokens: Column, width: int = WIDTH) -> Column:
    """The same as SHA-1 digests of NUL-joined tokens, for comparison with other systems."""
    return _shingles(tokens, width, lambda s: F.sha1(s))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two sets in arrays: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(left, right))
    every = F.size(left) + F.size(right) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def newline_count(text: Column) -> Column:
    """Lines including an unterminated last one; 0 for the empty text."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def split_lines(text: Column) -> Column:
    """Lines at any of ten separators; no empty line after the last separator."""
    parts = F.split(text, LINE_END, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def last_characters(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def first_characters(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def same_output(actual: Column, expected: Column, checker: str = "token") -> Column:
    """Whether an output is right: the same words (token) or the same characters (exact)."""
    if checker == "token":
        return words(actual) == words(expected)
    if checker == "exact":
        return actual == expected
    raise ValueError(f"unknown checker {checker!r}")


def record_json(*columns: str) -> Column:
    """A record as one JSON text to search in, nulls included; white space around separators is left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
