"""Lexical features: aggregates over the token rows of a sentence.

Punctuation is left out of every count and of every denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W
from plainread.operators.lookup import BROADCAST_BYTES, Words, lookup

NORM_FEATURES = {"avg_age_of_acquisition": "aoa", "avg_concreteness": "concreteness",
                 "avg_imagery": "imagery", "avg_familiarity": "familiarity"}


def spoken() -> Column:
    return F.col("pos") != "PUNCT"


def pos_counts() -> dict[str, Column]:
    pos = F.col("pos")
    return {"nouns": F.count_if(rules.one_of(pos, ["NOUN", "PROPN"])),
            "verbs": F.count_if(pos == "VERB"), "adjectives": F.count_if(pos == "ADJ"),
            "adverbs": F.count_if(pos == "ADV"), "pronouns": F.count_if(pos == "PRON")}


def person_counts(compat: bool = False, listed: Column | None = None) -> dict[str, Column]:
    """First-person pronouns and all other pronouns (compat: none and all).  ``listed`` tells what
    is first person, by default the built-in list."""
    pronoun = F.col("pos") == "PRON"
    first = rules.one_of(F.col("lower"), W.FIRST_PERSON) if listed is None else listed
    first = F.lit(False) if compat else first
    return {"first_person_pronouns": F.count_if(pronoun & first),
            "third_person_pronouns": F.count_if(pronoun & ~first)}


def mean_syllables() -> dict[str, Column]:
    total = F.sum(F.when(spoken(), F.coalesce("syllables", F.lit(0))))
    return {"avg_syllables_per_word": rules.ratio(total, F.count_if(spoken()))}


def negations() -> dict[str, Column]:
    return {"negations": F.count_if(spoken() & (F.col("dep") == "neg"))}


def with_lexicons(tokens: DataFrame, keys: Sequence[str], zipf: DataFrame | None = None,
                  norms: DataFrame | None = None, limit: int = BROADCAST_BYTES,
                  rule_words: DataFrame | None = None, words: Words | None = None) -> DataFrame:
    """Token rows with the columns ``zipf``, the four norms and ``rule_categories`` where tables
    are given.  ``words`` are their words (lower, base), for tables too large to broadcast."""
    spread = [*keys, "sent_id"]
    if rule_words is not None:
        tokens = lookup(tokens, rule_words, "lower", "word", ["rule_categories"], spread, limit=limit, words=words)
    if zipf is not None:
        tokens = lookup(tokens, zipf, "lower", "word", ["zipf"], spread, rank="n", limit=limit, words=words)
    if norms is not None:
        tokens = lookup(tokens, norms, "base", "word", list(NORM_FEATURES.values()), spread,
                        limit=limit, words=words, uses=zipf)
    return tokens


def frequency_means(known: bool = True) -> dict[str, Column]:
    """Mean Zipf frequency; unknown words count as 0.

    The content-word sum is divided by all spoken tokens, not by content words.
    Frequencies have two decimals, so sums are rounded to two: the result then does
    not depend on the order in which rows are added.
    """
    if not known:
        return {"avg_word_frequency_log": F.first(F.lit(0.0)),
                "avg_content_word_frequency_log": F.first(F.lit(0.0))}
    content = rules.one_of(F.col("pos"), W.FREQUENCY_POS)
    n = F.count_if(spoken())

    def total(test: Column) -> Column:
        return F.round(F.sum(F.when(test, F.col("zipf"))), 2)

    return {"avg_word_frequency_log": rules.ratio(total(spoken()), n),
            "avg_content_word_frequency_log": rules.ratio(total(content), n)}


def norm_means(known: bool = True) -> dict[str, Column]:
    """Mean rating over rated tokens; a rating of 0 counts as missing."""
    if not known:
        return {name: F.first(F.lit(0.0)) for name in NORM_FEATURES}
    return {name: F.coalesce(F.avg(F.when(spoken() & (F.col(c) != 0), F.col(c))), F.lit(0.0))
            for name, c in NORM_FEATURES.items()}
