"""Surface features: aggregates over the token rows of a sentence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W


def lengths() -> dict[str, Column]:
    """Characters of the sentence and its tokens, punctuation included."""
    return {"sentence_length": F.coalesce(F.first("n_chars"), F.lit(0)).cast("bigint"),
            "word_count": F.count("text")}


def connectives(lists: Mapping[str, Sequence[str]] = W.CONNECTIVES) -> dict[str, Column]:
    """Per category: listed words tagged as conjunctions; a word may count in several."""
    conjunction = rules.one_of(F.col("pos"), W.CONJUNCTION_POS)
    return {f"{name}_connectives": F.count_if(conjunction & rules.one_of(F.col("lower"), words))
            for name, words in lists.items()}


def rule_connectives() -> dict[str, Column]:
    """The same by a rule set's own lists: token rows hold ``rule_categories``."""
    conjunction = rules.one_of(F.col("pos"), W.CONJUNCTION_POS)
    return {f"{name}_connectives": F.count_if(conjunction & in_category(name)) for name in W.CONNECTIVES}


def in_category(name: str) -> Column:
    return F.coalesce(F.array_contains("rule_categories", name), F.lit(False))


def connectives_total(lists: Mapping[str, Sequence[str]] = W.CONNECTIVES,
                      compat: bool = False) -> Column:
    """Sum of the category counts, over columns already computed (compat: 0)."""
    total = F.lit(0).cast("bigint")
    for name in () if compat else lists:
        total = total + F.col(f"{name}_connectives")
    return total


def phrase_pattern(phrase: str) -> str:
    """Regular expression of a phrase; "..." stands for any words between."""
    parts = [re.escape(p.strip()).replace("\\ ", " ") for p in phrase.split("...")]
    return r"\b" + r"\b.*?\b".join(parts) + r"\b"


def multi_word(phrases: Sequence[str]) -> list[str]:
    return [p for p in phrases if " " in p]


def phrase_counts(text: Column, lists: Mapping[str, Sequence[str]] = W.CONNECTIVES
                  ) -> dict[str, Column]:
    """Occurrences of the multi-word connectives per category in a sentence text."""
    lower = F.lower(text)
    out = {}
    for name, phrases in lists.items():
        count = F.lit(0)
        for phrase in multi_word(phrases):
            count = count + F.regexp_count(lower, F.lit(phrase_pattern(phrase)))
        out[f"{name}_phrases"] = count.cast("bigint")
    return out


def word_kinds() -> dict[str, Column]:
    content = rules.one_of(F.col("pos"), W.FREQUENCY_POS)
    other = rules.one_of(F.col("pos"), ["PUNCT", "NUM"])
    return {"_content_words": F.count_if(content), "_function_words": F.count_if(~content & ~other)}


def function_content_ratio(compat: bool = False) -> Column:
    """Function words (neither content nor punctuation, number) over content words."""
    if compat:
        return F.lit(0.0)
    return rules.ratio(F.col("_function_words"), F.col("_content_words"))
