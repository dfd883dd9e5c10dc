"""Text expressions: cleaning, counts, keyword flags, state codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ledgerspark import constants as K


def description(column: str = "description") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def strip(column: Column) -> Column:
    """Trim every Unicode whitespace character, not only blanks."""
    return F.regexp_replace(column, rf"^[{K.SPACE}]+|[{K.SPACE}]+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.NON_SPACE_RUN))


def text_stats(text: Column) -> dict[str, Column]:
    return {
        "description_word_count": word_count(text),
        "description_char_count": F.length(text),
        "description_digit_count": F.regexp_count(text, F.lit(r"\p{Nd}")),
        "description_special_char_count": F.regexp_count(text, F.lit(rf"[^{K.WORD}{K.SPACE}]")),
    }


def has_state_code(text: Column) -> Column:
    return F.upper(text).rlike(K.STATE_PATTERN).cast("int")


def keyword_flags(text: Column, literal_case: bool = False) -> dict[str, Column]:
    """Keyword columns.  ``literal_case`` matches the lower-case patterns against upper-cased text."""
    subject = F.upper(text) if literal_case else F.lower(text)
    return {name: subject.rlike(pattern).cast("int") for name, pattern in K.KEYWORD_PATTERNS.items()}


def extended_flags(text: Column) -> dict[str, Column]:
    upper = F.upper(text)
    hits = [upper.contains(word).cast("int") for word in K.ENTERTAINMENT_KEYWORDS]
    return {
        "is_subscription_keyword": upper.rlike("|".join(K.SUBSCRIPTION_KEYWORDS)).cast("int"),
        "entertainment_keyword_count": reduce(lambda a, b: a + b, hits),
        "is_entertainment_merchant": upper.rlike(K.ENTERTAINMENT_MERCHANT_PATTERN).cast("int"),
    }


def has_term(text: Column, terms: list[str]) -> Column:
    """Case-insensitive whole-word match of any of ``terms``."""
    return F.lower(text).rlike(rf"(?<![{K.WORD}])(?:{'|'.join(terms)})(?![{K.WORD}])")


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{K.WORD}]{{2,}}"), F.lit(0))
