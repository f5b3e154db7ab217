"""Text scalar functions.

All are native column expressions, so they stay inside whole-stage codegen
(the array higher-order functions run interpreted, but JVM-side).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from askbase.constants import IGNORE_TOKENS

# Python's unicode ``\W`` equals "not a letter, digit or underscore"; Spark's
# ``\W`` is ASCII-only, so we spell the class out.
NON_WORD = r"[^\p{L}\p{N}_]"
# Code points 128..255 are removed before matching (Latin-1 block).
LATIN1_HIGH = "[\u0080-ÿ]"
# Unicode white space and separators: the characters str.strip() removes.
BLANK_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
UNICODE_BLANK = "^" + BLANK_CLASS + "+|" + BLANK_CLASS + "+$"
# A word or a single non-blank non-word character (our own tokenizer rule).
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\s\x{0B}\p{Z}\p{L}\p{N}_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def casefold_lower(text, turkish: bool = False) -> Column:
    """Locale-free lower-casing; ``turkish`` maps dotted/dotless I first."""
    c = _c(text)
    if turkish:
        c = F.translate(c, "İI", "iı")
    return F.lower(c)


def token_sort_key(text) -> Column:
    """The key the matcher compares.

    Drop code points 128-255, non-word characters become blanks, lower-case,
    split on blanks, sort tokens by code point, join with one blank.
    """
    c = F.regexp_replace(_c(text), LATIN1_HIGH, "")
    c = F.lower(F.regexp_replace(c, NON_WORD, " "))
    toks = F.filter(F.split(F.trim(c), " +"), lambda t: t != "")
    return F.array_join(F.sort_array(toks), " ")


def tokenize_clean(text) -> Column:
    """Lower-case, split into words and single punctuation marks, drop ? ! , ."""
    toks = F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_OR_PUNCT), 0)
    ignore = F.array(*[F.lit(t) for t in IGNORE_TOKENS])
    return F.filter(toks, lambda t: ~F.array_contains(ignore, t))


def strip_text(text) -> Column:
    """T5: Unicode strip (``trim`` alone strips only U+0020)."""
    return F.regexp_replace(_c(text), UNICODE_BLANK, "")


def utf8_clean(text) -> Column:
    """Drop undecodable bytes; identity on valid text.

    ``make_valid_utf8`` substitutes U+FFFD for each bad sequence, which we
    then remove.  Only applied to strings that are actually invalid, so a
    genuine U+FFFD in valid text is kept.
    """
    c = _c(text)
    return F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(F.make_valid_utf8(c), "�", ""))


def contains_any(text, phrases) -> Column:
    """F1 core: raw substring test against any phrase (no word boundary)."""
    c = _c(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out
