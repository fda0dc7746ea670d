"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded: lower case, accents off, look-alike letters and digits written as letters,
separators inside a word (i.d.i.o.t) off.  All terms of the lexicon are found in one pass of an
Aho-Corasick automaton.  A term is a whole word or a word's beginning; its weight is the log odds
of toxic against other training texts that hold it.  Matches inside an exception phrase don't count.
The evidence, weights per word of the text damped by its length, and the strongest single term go
through a logistic curve fitted on the same training rows.

Defined results: null and empty texts have evidence 0 and get the curve's lowest score; without
labelled rows of both kinds the lexicon given by the caller (or none) and a fixed curve are used;
repeated rows get a row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import carried, texts, unpacked
from plainread.session import materialize

#: Bound of the training sample, rows of a label.
SAMPLE_ROWS = 6000
LEAST_PREFIX, MOST_PREFIX = 4, 12
MIN_DOCS = 3
MIN_WEIGHT = 2.0
MARGIN = 4.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "not stupid",
              "not an idiot", "not a loser", "not worthless")
#: Letters written by look-alikes.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o",
    "ł": "l", "ı": "i", "đ": "d",
}
DIGIT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: A word with digits or signs for letters: they count as letters only beside one.
MIXED = re.compile(r"(?<![^\s])(?=\S*[a-z])\S*[0134578@$!|€]\S*")
SPACED = re.compile(r"\b(?:[a-z][.\-*_ ]){3,}[a-z]\b")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
NOT_LETTER = re.compile(r"[^a-z]+")


class Folding(dict):
    """A table for str.translate that folds a character when first met."""

    def __missing__(self, code: int) -> str | int:
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        made = "".join(LOOK_ALIKE.get(c, c) for c in plain if not unicodedata.combining(c))
        self[code] = made
        return made


FOLDING = Folding()


def fold(text: str) -> str:
    """Words of letters a-z, blanks between and around them."""
    low = text.lower()
    if not low.isascii():
        low = INVISIBLE.sub("", low).translate(FOLDING)
    low = MIXED.sub(_digits, low)
    low = SPACED.sub(_joined, low)
    return f" {NOT_LETTER.sub(' ', low).strip()} "


def _digits(found: re.Match) -> str:
    """Digits and signs as letters, but not at the word's end, where they are punctuation, and
    not in tokens that are mostly digits."""
    word = found[0]
    core = word.rstrip("0123456789!|.,;:?)\"'")
    letters = sum("a" <= c <= "z" for c in core)
    if letters < 2 or 3 * letters < len(core):
        return word
    return "".join(DIGIT.get(c, c) for c in core) + word[len(core):]


def _joined(found: re.Match) -> str:
    return re.sub(r"[^a-z]", "", found[0])


@dataclass
class Lexicon:
    """Terms with weights: " word " is a whole word, " word" a beginning."""

    weights: Mapping[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase := fold(phrase), (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out


def evidence(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    """(sum of weights by the logarithm of the length in words, largest weight, matches)."""
    if not len(automaton) or len(folded) < 3:
        return 0.0, 0.0, 0
    found, spared = [], []
    for end, (size, weight) in automaton.iter(folded):
        (spared if weight is None else found).append((end + 1 - size, end + 1, weight))
    if spared and found:
        # A match is spared if an exception that begins no later ends no earlier.
        begins, ends = np.array(sorted((a, b) for a, b, _ in spared)).T
        reach = np.r_[-1, np.maximum.accumulate(ends)]
        before = np.searchsorted(begins, [f[0] for f in found], "right")
        found = [f for f, end in zip(found, reach[before].tolist()) if end < f[1]]
    best: dict[int, float] = {}
    for begin, _, weight in found:  # one match a word: its strongest term
        best[begin] = max(weight, best.get(begin, 0.0))
    if not best:
        return 0.0, 0.0, 0
    words = folded.count(" ") - 1
    return sum(best.values()) / math.log2(2 + words), max(best.values()), len(best)


def sampled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, rows: int
            ) -> tuple[DataFrame, dict[int, int]]:
    """((_text, _y), rows of each label): of each label about ``rows`` documents at most, drawn by the
    hash of their ids.  Only ids drawn are broadcast, twice ``rows`` of them, so no text is moved."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)")
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_y") == 1, rows / max(1, sizes.get(1, 0))).otherwise(rows / max(1, sizes.get(0, 0)))
    drawn = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))
    whole = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return materialize(whole.join(F.broadcast(drawn), "_id").select("_text", "_y").dropDuplicates(["_text"]), "labelled"), sizes


def term_counts(sample: DataFrame) -> DataFrame:
    """(_term, _toxic, _other): in how many texts of either label each term occurs."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(texts(batch, "_text"), batch.column("_y").to_pylist()):
                words = set(fold(text).split())
                own = {f" {w} " for w in words if len(w) > 2}
                own.update(f" {w[:n]}" for w in words for n in range(LEAST_PREFIX, min(len(w), MOST_PREFIX) + 1))
                for term in own:
                    counts.setdefault(term, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict({
                "_term": list(counts), "_other": [c[0] for c in counts.values()],
                "_toxic": [c[1] for c in counts.values()]}) if counts else pa.RecordBatch.from_arrays(
                [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())],
                ["_term", "_other", "_toxic"])

    return sample.mapInArrow(terms, "_term string, _other bigint, _toxic bigint").groupBy("_term").agg(
        F.sum("_other").alias("_other"), F.sum("_toxic").alias("_toxic"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic", sample_rows: int = SAMPLE_ROWS, exceptions: Sequence[str] = EXCEPTIONS,
        min_weight: float = MIN_WEIGHT) -> Lexicon:
    """A lexicon from the documents that ``labels`` (<doc_id>, <label> 0 or 1) names: the terms with the
    strongest weight, of nested terms the one found in more texts unless the longer is clearly
    stronger.  Null labels are not used."""
    sample, whole = sampled(docs, labels, text, doc_id, label, sample_rows)
    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, exceptions)
    counts = materialize(term_counts(sample), "terms")
    base = sizes[1] / (sizes[0] + sizes[1])
    t, o = F.col("_toxic"), F.col("_other")
    weight = F.log((t + 0.5) / (sizes[1] + 1.0)) - F.log((o + 0.5) / (sizes[0] + 1.0))
    # With so many terms tried, chance alone must be ruled out: the log likelihood ratio against
    # an even spread over the labels has to pass that of the luckiest of them, with a margin.
    chance = t * F.log(t / ((t + o) * base)) + F.when(o > 0, o * F.log(o / ((t + o) * (1 - base)))).otherwise(0)
    found = (counts.filter(t >= MIN_DOCS).withColumn("_w", weight)
             .filter((F.col("_w") >= min_weight) & (chance >= math.log(max(1, counts.count())) + MARGIN))
             .orderBy(F.desc(F.col("_w") * t), "_term").collect())  # bounded by the sampled rows
    weights: dict[str, float] = {}
    for row in found:
        term = row["_term"]
        shorter = [weights[term[:n]] for n in range(LEAST_PREFIX + 1, len(term)) if term[:n] in weights]
        longer = any(t.startswith(term) for t in weights)
        if not longer and (not shorter or max(shorter) + 0.5 < row["_w"]):
            weights[term] = row["_w"]
    return Lexicon(weights, exceptions, curve(sample, Lexicon(weights, exceptions), sizes, whole))


def curve(sample: DataFrame, lexicon: Lexicon, sizes: dict[int, int], whole: dict[int, int]
          ) -> tuple[float, float, float]:
    """(bias, slope of the damped sum, slope of the largest weight), by Newton steps on the
    sample's evidence, counted in cells; rows weigh as the labels do in ``whole``."""
    measured = measure(sample, lexicon, "_text", ["_y"])
    cells = measured.groupBy("_y", F.round("_sum", 1).alias("a"), F.round("_peak", 1).alias("b")).agg(
        F.count("*").alias("n")).collect()  # a cell for each pair of tenths: bounded by the weights
    x = np.array([[1.0, r["a"], r["b"]] for r in cells])
    y = np.array([r["_y"] for r in cells], float)
    n = np.array([r["n"] * whole[r["_y"]] / sizes[r["_y"]] for r in cells])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.1 * beta
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def measure(docs: DataFrame, lexicon: Lexicon, text: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns with _sum, _peak and n_matches of every whole text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                       F.col(f"`{text}`").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [evidence(fold(t), automaton) for t in texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *[pa.array([f[i] for f in found], t) for i, t in (
                    (0, pa.float64()), (1, pa.float64()), (2, pa.int64()))]],
                ["_row", "_sum", "_peak", "n_matches"])

    made = rows.mapInArrow(scan, carried(rows, "_row", "_sum double, _peak double, n_matches bigint"))
    return unpacked(made, "_row", keep, ["_sum", "_peak", "n_matches"])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text",
          keep: Sequence[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default all) with score (0 to 1) and n_matches."""
    columns = list(docs.columns if keep is None else keep)
    bias, slope, peak = lexicon.curve
    made = measure(docs, lexicon, text, columns)
    logit = F.lit(bias) + F.lit(slope) * F.col("_sum") + F.lit(peak) * F.col("_peak")
    return made.withColumn("score", 1 / (1 + F.exp(-logit))).drop("_sum", "_peak")
