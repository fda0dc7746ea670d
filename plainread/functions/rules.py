"""Column functions of the rule annotator and small shared helpers.

They stand where a statistical tagger would stand; callers that own a tagger
bring a token table instead.  Listed words and suffix rules are fixed tables joined
by broadcast: a long CASE would outgrow what the JVM compiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainread.functions import wordlists as W

# Bits of the word-level ``flag``.
BE, HAVE, NEGATION, PARTICIPLE, NOMINAL, FORWARD, ED = 1, 2, 4, 8, 16, 32, 64
NOMINAL_POS = ["NOUN", "PROPN", "PRON"]
FORWARD_POS = ["DET", "ADP", "ADJ", "NUM"]


def one_of(col: Column, words) -> Column:
    return col.isin(list(words))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def listed_words() -> dict[str, tuple[str, str, int]]:
    """form -> (tag, lemma, flag) of all listed words; the first class of a form wins."""
    table: dict[str, tuple[str, str]] = {}
    for tag, forms in W.CLOSED_CLASS.items():
        for form in forms:
            table.setdefault(form, (tag, form))
    for form, base in W.IRREGULAR_PAST.items():
        table.setdefault(form, ("VERB", base))
    for form in W.BASE_VERBS:
        table.setdefault(form, ("VERB", form))
    for form, base in W.IRREGULAR_NOUNS.items():
        table.setdefault(form, ("NOUN", base))
    lemmas = {**dict.fromkeys(W.BE_FORMS, "be"), **dict.fromkeys(W.HAVE_FORMS, "have"),
              "does": "do", "did": "do"}
    return {form: (tag, lemmas.get(form, base),
                   BE * (form in W.BE_FORMS) + HAVE * (form in W.HAVE_FORMS)
                   + NEGATION * (form in W.NEGATIONS))
            for form, (tag, base) in table.items()}


def listed_word_table(spark: SparkSession) -> DataFrame:
    """The listed words as a local table (about 250 fixed rows)."""
    rows = ", ".join(f"('{form}', '{tag}', '{base}', {flag}, "
                     f"{str(form in W.IRREGULAR_PAST).lower()})"
                     for form, (tag, base, flag) in listed_words().items())
    return spark.sql(f"SELECT * FROM VALUES {rows} "
                     "AS listed(form, listed_tag, listed_lemma, listed_flag, is_past)")


def suffix_table(spark: SparkSession) -> DataFrame:
    """The suffix rules as a local table (about 20 fixed rows)."""
    rows = ", ".join(f"('{suffix}', {shortest}, '{tag}', {drop}, '{add}')"
                     for suffix, (shortest, tag, drop, add) in W.SUFFIX_RULES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} "
                     "AS suffixes(suffix, shortest, suffix_tag, suffix_drop, suffix_add)")


def suffix_of(lower: Column) -> Column:
    """The longest listed suffix of a word, or an empty string."""
    longest = sorted(W.SUFFIX_RULES, key=len, reverse=True)
    found = F.when(lower.endswith(F.lit(longest[0])), longest[0])
    for suffix in longest[1:]:
        found = found.when(lower.endswith(F.lit(suffix)), suffix)
    return F.when(lower.isNotNull(), found.otherwise(""))


def syllables(lower: Column, is_alpha: Column) -> Column:
    """Vowel runs, at least one for a word of letters, none for anything else."""
    return (F.when(is_alpha, F.greatest(F.regexp_count(lower, F.lit(W.VOWEL_RUN)), F.lit(1)))
            .otherwise(F.lit(0)).cast("int"))


def hash_bucket(text: Column, width: int = W.EMBEDDING_WIDTH) -> Column:
    """Stable bucket of a string: leading 32 bits of its MD5, modulo ``width``."""
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(width)).cast("int")
