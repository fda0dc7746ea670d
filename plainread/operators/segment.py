"""Segmentation: documents to sentences, dot pieces and tokens.  All narrow, but for the sentences that
know abbreviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainread.functions import wordlists as W
from plainread.operators.lookup import lookup

#: A word; full stops inside belong to it.  Loops are possessive: no step back, no recursion in long texts.
WORD = r"\p{L}+(?:[.]\p{L}+)*+"
#: A stretch up to a sign that may end a sentence; a full stop with no blank after it is none.
STRETCH = (r"(?:[^.!?\n]+|[.][^ \t\n\f\r\x0B.!?])[^.!?\n]*"
           r"(?:[.][^ \t\n\f\r\x0B.!?][^.!?\n]*)*+[.!?]*\n?")
#: Full stops after an abbreviation, and the least score of one (Kiss and Strunk, 2006).
SURE, LEAST_SCORE = 0.99, 0.3


def sentence_array(text: Column) -> Column:
    """Sentences of a text, trimmed, without blank ones."""
    pieces = F.regexp_extract_all(text, F.lit(W.SENTENCE_PATTERN), F.lit(0))
    return F.transform(F.filter(pieces, lambda s: s.rlike(W.VISIBLE_PATTERN)),
                       lambda s: F.trim(s))


def token_array(sentence: Column) -> Column:
    """Runs of letters, runs of digits, and single symbols."""
    return F.regexp_extract_all(sentence, F.lit(W.TOKEN_PATTERN), F.lit(0))


def sentences(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, sent_id, text), numbered from 0 within a document."""
    return (docs.select(*keys, F.posexplode(sentence_array(F.col(text))).alias("sent_id", "text")))


def abbreviations(docs: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(word, n, n_dotted, score): words whose full stop is their own, learned from the corpus alone.

    The likelihood ratio that a full stop follows the word nearly always, rather than as often as it follows
    any word; short words, full stops inside, and no use without one speak for an abbreviation.  Words are
    lower-cased and counted where they stand, so a word in a third of the text is a row a task.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD + "[.]?"), F.lit(0))).alias("_w"))
    dotted = F.col("_w").endswith(".")
    counts = words.groupBy(F.rtrim("_w", F.lit(".")).alias("word")).agg(
        F.count("*").alias("n"), F.count_if(dotted).alias("n_dotted"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.sum("n_dotted").alias("d")).alias("s")).scalar()
    share = F.col("_s.d") / F.col("_s.n")
    rest = F.col("n") - F.col("n_dotted")
    ratio = -2.0 * (F.col("n_dotted") * F.log(share / SURE) + F.when(
        rest > 0, rest * F.log((1.0 - share) / (1.0 - SURE))).otherwise(0.0))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inside = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * inside * F.pow(letters.cast("double"), -rest)
    return counts.withColumn("_s", whole).filter("n_dotted > 0").select(
        "word", "n", "n_dotted", score.alias("score")).filter(F.col("score") >= least)


def known_sentences(docs: DataFrame, known: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, sent_id, text) as ``sentences``, but a full stop ends none after a word of ``known`` (word, ...;
    materialized, as its size decides the kind of join) or with no blank after it.

    A line end always ends a sentence.  The text is shuffled once, by document.
    """
    keys = list(keys)
    pieces = docs.select(*keys, text).repartition(*keys).select(*keys, F.posexplode(F.regexp_extract_all(
        F.col(text), F.lit(STRETCH), F.lit(0))).alias("_at", "_piece"))
    last = F.lower(F.regexp_extract("_piece", rf"({WORD})[.] *\z", 1))
    rows = pieces.withColumn("_last", F.when(last != "", last))
    table = known.select("word", F.lit(True).alias("_open"))
    rows = lookup(rows, table, "_last", "word", ["_open"], [*keys, "_at"])
    order = Window.partitionBy(*keys).orderBy("_at")
    opens = F.when(F.coalesce(F.lag("_open").over(order), F.lit(False)), 0).otherwise(1)
    numbered = rows.withColumn("_opens", opens).withColumn("_no", F.sum("_opens").over(order))
    joined = F.trim(F.translate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))),
                                                         lambda p: p["_piece"]), ""), "\n", ""))
    whole = numbered.groupBy(*keys, "_no").agg(joined.alias("text")).filter(F.col("text").rlike(W.VISIBLE_PATTERN))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_no")) - 1
    return whole.select(*keys, place.alias("sent_id"), "text")


def dot_segments(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                 keep_blank: bool = False) -> DataFrame:
    """(keys, seg_id, sentence): the pieces between literal dots.

    Blank pieces are dropped unless ``keep_blank``; numbers count all pieces.
    """
    out = docs.select(*keys, F.posexplode(F.split(F.col(text), "[.]")).alias("seg_id", "sentence"))
    return out if keep_blank else out.filter(F.col("sentence").rlike(W.VISIBLE_PATTERN))


def tokens(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, sent_id, tok_idx, text, is_alpha): plain tokens without annotation."""
    rows = sentences(docs, keys, text)
    rows = rows.select(*keys, "sent_id",
                       F.posexplode(token_array(F.col("text"))).alias("tok_idx", "text"))
    return rows.withColumn("is_alpha", F.col("text").rlike(r"^\p{L}+$"))
