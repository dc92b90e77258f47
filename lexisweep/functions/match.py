"""Counting occurrences of a literal pattern in a text column.

Every count is exact on bytes, case sensitive, and counts overlapping
occurrences.  All of it is built-in expressions, so the text never leaves the
JVM.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the word characters.  ASCII only; any other character, accented
# letters included, is a word boundary.
WORD_CHARACTERS = "A-Za-z0-9_"

_WORD = f"[{WORD_CHARACTERS}]"
_NOT_WORD = f"[^{WORD_CHARACTERS}]"


def quote_pattern(pattern: str) -> str:
    """A regular expression that matches ``pattern`` literally."""
    return "".join(
        "\\" + char if char.isascii() and not char.isalnum() else char
        for char in pattern
    )


def overlap_shifts(pattern: str) -> list[int]:
    """The distances at which two occurrences of ``pattern`` can overlap.

    There is one for each proper prefix that is also a suffix: 3 for ``test``,
    1 and 2 for ``aaa``, none for ``tion``.
    """
    size = len(pattern)
    return [s for s in range(1, size) if pattern[s:] == pattern[: size - s]]


def match_regex(pattern: str, whole_words: bool = False) -> str:
    """A regular expression with one match per occurrence of ``pattern``.

    A match consumes just the characters up to where the next occurrence can
    start and looks ahead at the rest, so overlaps count.  The literal comes
    first and the boundary tests after it, which keeps the regex engine in its
    literal search until a candidate is found.
    """
    check_pattern(pattern)
    shift = min(overlap_shifts(pattern), default=len(pattern))
    head, tail = quote_pattern(pattern[:shift]), quote_pattern(pattern[shift:])
    if not whole_words:
        return f"{head}(?={tail})" if tail else head
    free_after = f"(?!{_WORD})"
    if tail:
        free_after = f"(?={tail}{free_after})"
    return f"{head}{free_after}(?<!{_WORD}{head})"


def check_pattern(pattern: str) -> None:
    if not isinstance(pattern, str):
        raise TypeError("pattern must be a string")
    if not pattern:
        raise ValueError("pattern must not be empty")


def count_substring(text, pattern: str) -> Column:
    """Number of positions of ``text`` at which ``pattern`` starts."""
    check_pattern(pattern)
    text = _column(text)
    # Removing all occurrences that do not overlap shortens the text by one
    # pattern each.  No decoding to characters, no regular expression.
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))
    count = F.call_function("div", removed, F.lit(len(pattern.encode("utf-8"))))
    shifts = overlap_shifts(pattern)
    if shifts:
        by_regex = F.regexp_count(text, F.lit(match_regex(pattern)))
        count = F.when(_has_overlap(text, pattern, shifts), by_regex).otherwise(count)
    return _where_contained(text, pattern, count)


def count_whole_word(text, pattern: str) -> Column:
    """As :func:`count_substring`, but only occurrences with no word character
    next to them.  Neighbouring occurrences may share a separator."""
    text = _column(text)
    regex = match_regex(pattern, whole_words=True)
    return _where_contained(text, pattern, F.regexp_count(text, F.lit(regex)))


def match_count(text, pattern: str, whole_words: bool = False) -> Column:
    """Occurrences of ``pattern``; a null text has none."""
    count = count_whole_word if whole_words else count_substring
    return count(text, pattern)


def is_word_char(char) -> Column:
    """Whether a one-character string is a word character."""
    return ~_column(char).rlike(_NOT_WORD)


def count_word_chars(text) -> Column:
    """How many characters of a text are word characters."""
    # What is left without the runs of others; word characters are a byte each.
    words = F.regexp_replace(_column(text), F.lit(f"{_NOT_WORD}+"), F.lit(""))
    return F.octet_length(words).cast("bigint")


def _has_overlap(text: Column, pattern: str, shifts: list[int]) -> Column:
    """Whether two occurrences overlap; rare in prose, and cheap to find out.

    With many possible shifts it is cheaper to assume so.
    """
    if len(shifts) > 2:
        return F.lit(True)
    return reduce(or_, (F.contains(text, F.lit(pattern[:s] + pattern)) for s in shifts))


def _where_contained(text: Column, pattern: str, count: Column) -> Column:
    # The byte search is far cheaper than any count, and most rows fail it.
    found = F.contains(text, F.lit(pattern))
    return F.when(found, count.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
