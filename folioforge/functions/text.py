"""Column-level text helpers shared by every operator.

All helpers return Spark ``Column`` expressions, so Catalyst sees (and can push
down, prune or code-generate) everything.  Three JVM traps are handled here once:

* ``\\b`` is Unicode-aware in Java; the rules of this package need the ASCII word
  boundary, so boundaries are spelled out as look-arounds.
* ``\\s`` and ``trim`` in Java/Spark do not know NBSP, BOM and the Unicode space
  separators; ``WS``/``WS_CHARS`` list the whole whitespace set.
* ``$`` in Java also matches before a final line break; ``\\z`` is used instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as understood by the text rules (ASCII blanks plus Unicode separators).
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ASCII is decided by the first test; only characters from NBSP upwards see the long list.
WS = (
    "[\\s[\\u00a0-\\uffff&&[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]]]"
)
NOT_EOL = "[^\\n\\r\\u2028\\u2029]"
BLANK_LINE = f"\\n{WS}*\\n"
SENTENCE_GAP = f"(?<=[.!?]){WS}+"
WORD_CHAR = "[A-Za-z0-9_]"
DIACRITICS = "[āīūṛṅñṭḍṇśṣḥ]"
INDIC = "\\u0A80-\\u0AFF\\u0900-\\u097F"
GUJARATI = "\\u0A80-\\u0AFF"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; a lambda variable is never re-evaluated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(value: Column | str) -> Column:
    return F.btrim(as_col(value), F.lit(WS_CHARS))


def non_blank(value: Column) -> Column:
    return trim_ws(value) != ""


def word_count(value: Column | str) -> Column:
    """Words separated by whitespace; blank text has none."""
    return let(
        trim_ws(value),
        lambda t: F.when(t == "", F.lit(0)).otherwise(inner_word_count(t)),
    )


def inner_word_count(value: Column) -> Column:
    """Words of text that is already trimmed and not empty (gaps between words plus one).

    For use inside lambdas: the pattern is compiled once per task, not once per call.
    """
    return F.regexp_count(value, F.lit(f"{WS}+")) + 1


def word_count_raw(value: Column | str) -> Column:
    """Pieces of a plain whitespace split: empty text counts as one piece."""
    return F.regexp_count(as_col(value), F.lit(f"{WS}+")) + 1


def count_matches(value: Column | str, char_class: str) -> Column:
    """Number of single characters in ``char_class`` (no match array is built)."""
    c = as_col(value)
    return F.length(c) - F.length(F.regexp_replace(c, char_class, ""))


def count_literal(value: Column | str, literal: str) -> Column:
    c = as_col(value)
    gone = F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))
    return (gone / F.lit(len(literal))).cast("int")


def script_ratio(value: Column | str, char_class: str = INDIC) -> Column:
    """Share of characters in the given script; null for empty text."""
    c = as_col(value)
    n = F.length(c)
    return F.when(n > 0, count_matches(c, f"[{char_class}]") / n)


def has_valid_script(value: Column | str, strict: bool = True) -> Column:
    """Long enough and at least 5 % Indic; ``strict`` excludes exactly 5 %."""
    c = as_col(value)
    ratio = script_ratio(c)
    enough = (ratio > 0.05) if strict else (ratio >= 0.05)
    return F.coalesce((F.length(c) > 50) & enough, F.lit(False))


def is_ocr_refusal(value: Column | str) -> Column:
    """Text came back, but almost none of it is in the expected script."""
    return F.coalesce(script_ratio(value, GUJARATI) < 0.05, F.lit(False))


def preview(value: Column | str, n: int = 200) -> Column:
    return F.substring(as_col(value), 1, n)


def is_book_mode(words: Column | str) -> Column:
    return as_col(words) > 3000


def warn_long(words: Column | str) -> Column:
    return as_col(words) > 6000


def estimated_chunks(words: Column | str) -> Column:
    return F.ceil(as_col(words) / F.lit(500)).cast("int")


def flag_band(flags: Column | str) -> Column:
    n = F.coalesce(as_col(flags), F.lit(0))
    return F.when(n == 0, "none").when(n <= 2, "some").otherwise("many")


def macron_count(value: Column | str) -> Column:
    return count_matches(value, "[Āā]")


def charset_violations(value: Column | str) -> Column:
    """Characters outside the alphabet that transliterated output may use."""
    allowed = "[A-Za-z 0-9.,;:!?\\-–\"'“”‘’()\\nāĀ]"
    return F.length(F.regexp_replace(as_col(value), allowed, ""))


def trimmed_lines(value: Column | str) -> Column:
    """Trimmed, non-blank lines of a block."""
    return F.filter(F.transform(F.split(as_col(value), "\n"), trim_ws), lambda line: line != "")


def one_line(value: Column) -> Column:
    return F.instr(value, "\n") == 0


def sentences(value: Column) -> Column:
    return F.filter(F.split(value, SENTENCE_GAP), lambda s: s != "")


def bounded(literal: str, ignore_case: bool = True) -> str:
    """Regex for ``literal`` as a whole word, ASCII boundaries.

    The literal comes first and the boundaries are checked around it afterwards:
    the engine can then search for the literal instead of testing a look-behind
    at every position.
    """
    body = _escape(literal)
    body = f"(?i:{body})" if ignore_case else body
    left = f"(?<!{WORD_CHAR}{body})" if is_word_char(literal[0]) else f"(?<={WORD_CHAR}{body})"
    right = f"(?!{WORD_CHAR})" if is_word_char(literal[-1]) else f"(?={WORD_CHAR})"
    return f"{body}{right}{left}"


def _any_pattern(literals: Sequence[str], ignore_case: bool) -> str:
    """One pattern that finds any of many whole words, the longest first, as group 1 or 2.

    The words are merged by common prefix, so at each word start the engine follows one
    path instead of trying every word.  The character before a word is matched, not
    looked back at: most positions fail on that first, cheap test.  (The text gets a
    leading blank for that; the character after a word is only looked at, so a match
    never uses up the start of the next one.)
    """
    words = {s.lower() if ignore_case else s for s in literals}
    inside, outside = {}, {}  # words that start with a word character, and the others
    for word in words:
        node = inside if is_word_char(word[0]) else outside
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = f"(?!{WORD_CHAR})" if is_word_char(word[-1]) else ""
    # \\W is ASCII in Java, and with exact case many times faster than the class spelled out
    inner = f"\\W({_prefix_regex(inside)})" if inside else None
    outer = f"({_prefix_regex(outside)})" if outside else None
    return ("(?i)" if ignore_case else "") + "|".join(p for p in (inner, outer) if p)


def word_trie(literals: Sequence[str]) -> str:
    """One pattern for any of many whole words in any case, merged by common prefix; what
    stands before them is the caller's to check."""
    root: dict = {}
    for word in {s.lower() for s in literals}:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = f"(?!{WORD_CHAR})"
    return _prefix_regex(root)


def contains_any(value: Column, literals: Sequence[str], ignore_case: bool = True) -> Column:
    return F.rlike(F.concat(F.lit(" "), value), F.lit(_any_pattern(literals, ignore_case)))


def extract_any(value: Column, literals: Sequence[str], ignore_case: bool = True) -> Column:
    """All occurrences of the words, as written in the text."""
    kinds = {is_word_char(s[0]) for s in literals}
    if len(kinds) > 1:
        raise ValueError("words with and without a leading word character need two passes")
    pattern = _any_pattern(literals, ignore_case)
    return F.regexp_extract_all(F.concat(F.lit(" "), value), F.lit(pattern), 1)


def _prefix_regex(node: dict) -> str:
    branches = [_escape(ch) + _prefix_regex(nxt) for ch, nxt in sorted(node.items()) if ch]
    if "" in node:  # a word ends here: tried last, so that longer words win
        branches.append(node[""])
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _escape(literal: str) -> str:
    return re.escape(literal).replace("\\ ", " ").replace("\\-", "-")


def is_word_char(ch: str) -> bool:
    return re.match(r"[A-Za-z0-9_]", ch) is not None


def quote_replacement(text: str) -> str:
    """Make a literal safe as the replacement side of ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def explode_indexed(
    df: DataFrame, array_col: str, keep: Sequence[str], index: str, item: str, count: str
) -> DataFrame:
    """One row per element of a computed array, with its position and the array size.

    The outer form is used and its null row removed afterwards: for a plain explode the
    optimizer infers a ``size(array) > 0`` filter and pushes it below the projection,
    which would compute the array a second time.
    """
    sized = df.select(*keep, F.size(array_col).alias(count), array_col)
    rows = sized.select(*keep, count, F.posexplode_outer(array_col).alias(index, item))
    return rows.filter(F.col(index).isNotNull())
