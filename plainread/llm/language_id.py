"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs.  An n-gram is the product of its letters' vectors, the
i-th from its end rotated i places (binding); a text is the sum of its n-grams (bundling).  The
prototype of a language is the sum of the unit vectors of its training texts, less the mean over
the languages.  A text gets the language whose prototype has the largest cosine with it.

Texts are lower-cased; what is no letter becomes one blank, so n-grams cross word borders.

Whether a text is in its language at all is judged by ``fits``: the cosine with the language's own
prototype, nothing subtracted, against bounds by text length that ``fit_bounds`` learns from pieces of
training texts.  The least of two bounds holds: far below what pieces of the language have, and above what
pieces of the other languages seldom reach.  Texts too short to tell fit.  A text below its bound is judged
again by its distinct words, as one word many times over says no more than once.

Defined results: null texts and texts without a letter give ``und`` with score 0; without
any training row every text gives ``und`` with score 0; ties go to the language first in
order; repeated rows get a row each; an empty table gives an empty table; only text and language
are looked at, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainread.llm.common import each, forget, texts

DIMENSIONS = 1024
GRAM = 3
SHARPNESS = 20.0
#: Pieces of 2^i letters: least and largest i, pieces of a text at each, and how many a bound needs.
LEAST_SIZE, MOST_SIZE = 3, 12
PIECES = 4
#: Cosines are counted to so many digits, so that quantiles take bounded memory.
COSINE_DIGITS = 5
LEAST_PIECES = 20
#: A bound lies so many standard deviations (from the lower quartile) under the median of the language's
#: own pieces, or this share of the way to that median from this quantile of the pieces of others.
SPREADS = 3.0
STRANGERS = 0.99
NEARER = 0.2
UNDETERMINED = "und"
DOCS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 20
GRAMS_AT_ONCE = 4096
TABLE_LETTERS = 64
GAPS = re.compile(r"[\W\d_]+")


def letters(text: str) -> np.ndarray:
    """Code points of the folded text, one blank at either end; empty without a letter."""
    folded = GAPS.sub(" ", text.lower()).strip()
    if not (folded[:1].isalpha() or any(map(str.isalpha, folded))):
        return np.empty(0, np.uint32)
    return np.frombuffer(f" {folded} ".encode("utf-32-le", "replace"), np.uint32)


def distinct_words(text: str) -> str:
    return " ".join(dict.fromkeys(GAPS.sub(" ", text.lower()).split()))


class Encoder:
    """Document vectors; letter vectors come from their code points alone."""

    def __init__(self, dimensions: int, gram: int) -> None:
        self.dimensions, self.gram = dimensions, gram
        self.number = np.full(0x110000, -1, np.int32)
        self.signs = np.empty((0, dimensions), np.int8)
        #: Vectors of n-grams of the first TABLE_LETTERS letters met, as far as they occurred.
        self.place = np.full(TABLE_LETTERS**gram, -1, np.int32) if gram <= 3 else None
        self.bound = np.empty((0, dimensions), np.int8)

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.number[codes] < 0])
        if len(new):
            made = [np.random.default_rng(int(c)).integers(0, 2, self.dimensions, np.int8) for c in new]
            self.number[new] = np.arange(len(self.signs), len(self.signs) + len(new))
            self.signs = np.concatenate([self.signs, np.array(made, np.int8) * 2 - 1])
        return self.number[codes]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as rows of letter numbers."""
        out = self.signs[grams[:, -1]]
        for i in range(1, grams.shape[1]):
            out *= np.roll(self.signs, i, axis=1)[grams[:, -1 - i]]
        return out

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """One row a document: the bundle of its n-grams."""
        sizes = np.array([max(0, len(d) - self.gram + 1) for d in docs])
        total = np.zeros((len(docs), self.dimensions), np.float32)
        if not sizes.any():
            return total
        numbers = self.numbered(np.concatenate(docs))
        lengths = np.array([len(d) for d in docs])
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(docs)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
        few = self.place is not None and numbers.max() < TABLE_LETTERS
        base = TABLE_LETTERS if few else len(self.signs)
        key = numbers[at].astype(np.int64)
        for i in range(1, self.gram):
            key = key * base + numbers[at + i]
        if few:
            seen = np.flatnonzero(np.bincount(key, minlength=len(self.place)))
            index = np.zeros(len(self.place), np.int32)
            index[seen] = np.arange(len(seen))
            inverse = index[key]
        else:
            seen, inverse = np.unique(key, return_inverse=True)
        for low in range(0, len(seen), GRAMS_AT_ONCE):
            part = seen[low:low + GRAMS_AT_ONCE]
            inside = (inverse >= low) & (inverse < low + len(part))
            counts = np.bincount(owner[inside] * len(part) + inverse[inside] - low,
                                 minlength=len(docs) * len(part)).astype(np.float32)
            total += counts.reshape(len(docs), len(part)) @ self.table(part, base, few).astype(np.float32)
        return total

    def table(self, keys: np.ndarray, base: int, few: bool) -> np.ndarray:
        def split(k: np.ndarray) -> np.ndarray:
            return np.stack([k // base**i % base for i in range(self.gram - 1, -1, -1)], axis=1)

        if not few:
            return self.bind(split(keys))
        new = keys[self.place[keys] < 0]
        if len(new):
            if len(self.bound) > 4 * GRAMS_AT_ONCE:
                self.place[:], self.bound, new = -1, self.bound[:0], keys
            self.place[new] = np.arange(len(self.bound), len(self.bound) + len(new))
            self.bound = np.concatenate([self.bound, self.bind(split(new))])
        return self.bound[self.place[keys]]

    def batches(self, rows: Iterator[str]) -> Iterator[np.ndarray]:
        """Document vectors of bounded blocks of texts."""
        for _, vectors in self.sized(map(letters, rows)):
            yield vectors

    def sized(self, rows: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same with the texts' numbers of letters."""
        held, chars = [], 0
        for codes in rows:
            held.append(codes)
            chars += len(codes)
            if len(held) == DOCS_AT_ONCE or chars > CHARS_AT_ONCE:
                yield np.array([len(d) for d in held]), self.vectors(held)
                held, chars = [], 0
        if held:
            yield np.array([len(d) for d in held]), self.vectors(held)


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int | None = None,
        dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes), of all rows with a language and a text.  With ``sample_rows`` about so many
    rows of each language at most are used, drawn by a hash of the row."""
    languages, matrix = fit_plain(train, text, lang, sample_rows, dimensions, gram)
    return languages, centred(matrix)


def centred(matrix: np.ndarray) -> np.ndarray:
    return unit(matrix - matrix.mean(axis=0) if len(matrix) > 1 else matrix)


def draw(train: DataFrame, text: str, lang: str, sample_rows: int | None) -> DataFrame:
    """(_lang, _text) of all training rows, or of a sample: about ``sample_rows`` rows of a language, drawn by a hash
    of the whole row, so texts that are repeated under other ids enter in their share; rows alike in
    all columns count once."""
    whole = [F.col(f"`{f.name}`") for f in train.schema if isinstance(f.dataType, T.AtomicType)]
    rows = train.select(F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").alias("_text"),
                        F.xxhash64(*whole).alias("_key")).filter(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    drawn = rows
    if sample_rows is not None:
        sizes = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
        share = F.lit(float(sample_rows)) / F.col("_n")
        drawn = rows.join(F.broadcast(sizes), "_lang").filter(F.pmod("_key", F.lit(1 << 20)) < share * (1 << 20))
    return drawn.groupBy("_lang", "_key").agg(F.first("_text").alias("_text")).select("_lang", "_text")


def fit_plain(train: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int | None = None,
              dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """The same before the mean over the languages is subtracted."""
    drawn = draw(train, text, lang, sample_rows)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sums = Encoder(dimensions, gram), {}
        for batch in batches:
            names = np.array(batch.column("_lang").to_pylist(), object)
            low = 0
            for vectors in tool.batches(texts(batch, "_text")):
                here = names[low:low + len(vectors)]
                low += len(vectors)
                for name in set(here):
                    sums[name] = sums.get(name, 0) + unit(vectors[here == name]).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_pydict({"_lang": list(sums), "_sum": [
                s.astype(float).tolist() for s in sums.values()]})

    sums = drawn.mapInArrow(bundle, "_lang string, _sum array<double>").select(
        "_lang", F.posexplode("_sum").alias("_i", "_x")).groupBy("_lang", "_i").agg(F.sum("_x").alias("_x"))
    prototypes = sums.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_all"))
    # A row a language: the size is that of the set of languages, not of the corpus.
    found = sorted((r["_lang"], [x["_x"] for x in r["_all"]]) for r in prototypes.collect())
    matrix = unit(np.array([v for _, v in found]).reshape(len(found), dimensions))
    return [name for name, _ in found], matrix


@dataclass
class Bounds:
    plain: np.ndarray  # prototypes, nothing subtracted
    least: np.ndarray  # a row a language: the bound for texts of 2^i letters or more, -1 where none is known

    def fits(self, vectors: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> np.ndarray:
        place = np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), self.least.shape[1] - 1)
        own = (unit(vectors) * self.plain[best]).sum(axis=1)
        return (own >= self.least[best, place]) & vectors.any(axis=1)


def fit_bounds(train: DataFrame, languages: list[str], plain: np.ndarray, text: str = "text", lang: str = "lang",
               sample_rows: int | None = None, gram: int = GRAM) -> Bounds:
    """Bounds from pieces of the texts of ``train``, all of them unless ``sample_rows`` is given; ``plain`` as ``fit_plain`` gives it."""
    least = np.full((len(languages), MOST_SIZE + 1), -1.0)
    number = {name: i for i, name in enumerate(languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(plain.shape[1], gram)
        for batch in batches:
            owners: list[int] = []

            def pieces() -> Iterator[np.ndarray]:
                for name, value in zip(batch.column("_lang").to_pylist(), texts(batch, "_text")):
                    codes = letters(value)
                    for i in range(LEAST_SIZE, MOST_SIZE + 1):
                        fit_in = min(PIECES, len(codes) >> i)
                        for j in range(fit_in):
                            begin = j * (len(codes) // fit_in)
                            owners.append(number.get(name, -1))
                            yield codes[begin:begin + (1 << i)]

            low = 0
            for sizes, vectors in tool.sized(pieces()):
                here = np.array(owners[low:low + len(sizes)])
                low += len(sizes)
                near = (unit(vectors) @ plain.T.astype(np.float32)).astype(float)
                at = np.arange(len(here))
                own = near[at, here]
                near[at, here] = -np.inf
                other = near.max(axis=1)
                length = np.log2(sizes).astype(np.int32)
                for name, cosine in ((here, own), (np.full(len(here), -1), other)):
                    fine = (here >= 0) & (cosine > -np.inf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[fine].astype(np.int32)), pa.array(length[fine]), pa.array(cosine[fine])],
                        ["_l", "_i", "_cos"])

    if not len(languages):
        return Bounds(plain, least)
    found = draw(train, text, lang, sample_rows).mapInArrow(measure, "_l int, _i int, _cos double")
    counted = found.groupBy("_l", "_i", F.round("_cos", COSINE_DIGITS).alias("_cos")).agg(F.count("*").alias("_n"))
    # A row a language and length; those of all strangers have the language -1.
    marks = {(r["_l"], r["_i"]): r for r in counted.groupBy("_l", "_i").agg(
        F.sum("_n").alias("n"), *[F.percentile("_cos", F.lit(share), F.col("_n")).alias(name) for share, name in (
            (0.25, "quarter"), (0.5, "half"), (STRANGERS, "high"))]).collect()}
    marks = {key: r for key, r in marks.items() if r["n"] >= LEAST_PIECES}
    for a in range(len(languages)):
        high = None
        for i in range(LEAST_SIZE, MOST_SIZE + 1):
            least[a, i] = least[a, i - 1]  # texts fit the better the longer they are
            high = marks[-1, i]["high"] if (-1, i) in marks else high
            if own := marks.get((a, i)):
                least[a, i] = own["half"] - SPREADS * (own["half"] - own["quarter"]) / 0.6745
                if high is not None:
                    least[a, i] = min(least[a, i], high + NEARER * (own["half"] - high))
    return Bounds(plain, least)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text: str = "text",
            keep: list[str] | None = None, gram: int = GRAM, bounds: Bounds | None = None) -> DataFrame:
    """The ``keep`` columns (default all) with lang_pred and score, and with ``bounds`` also fits.

    The score is the softmax weight of the best language over its cosines; fits says whether the
    text is in that language at all.
    """
    columns = docs.columns if keep is None else keep
    made = ["lang_pred", "score", *["fits"] * bool(bounds)]
    types = "lang_pred string, score double" + ", fits boolean" * bool(bounds)
    model = prototypes.astype(np.float32)

    # Only the text goes to the Python worker, only the findings come back: the row stays in the JVM.
    @F.arrow_udf(f"struct<{types.replace(' ', ':').replace(',:', ',')}>")
    def nearest(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        tool = Encoder(model.shape[1] if model.size else DIMENSIONS, gram)
        for column in parts:
            names, scores, fits = [], [], []
            if not len(languages):
                names, scores = [UNDETERMINED] * len(column), [0.0] * len(column)
                fits = [False] * len(column)
            else:
                for sizes, vectors in tool.sized(map(letters, each(column))):
                    near = (unit(vectors) @ model.T).astype(float)
                    best = near.argmax(axis=1)
                    weight = np.exp(SHARPNESS * (near - near.max(axis=1, keepdims=True)))
                    known = vectors.any(axis=1)
                    names += [languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                    scores += np.where(known, 1 / weight.sum(axis=1), 0.0).tolist()
                    if bounds:
                        fits += bounds.fits(vectors, sizes, best).tolist()
                if bounds:
                    again = [i for i, (name, fit) in enumerate(zip(names, fits)) if name != UNDETERMINED and not fit]
                    short = (distinct_words(column[i].as_py()) for i in again)
                    low = 0
                    for sizes, vectors in tool.sized(map(letters, short)):
                        part = again[low:low + len(sizes)]
                        low += len(sizes)
                        best = np.array([languages.index(names[i]) for i in part])
                        for i, fit in zip(part, bounds.fits(vectors, sizes, best).tolist()):
                            fits[i] = fit
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())]
            yield pa.StructArray.from_arrays(found[:len(made)], made)

    # Not to be evaluated again where its fields are used or filtered.
    found = nearest.asNondeterministic()(F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c not in made] or [F.lit(0)]).alias("_row"),
                       found.alias("_found"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns if c not in made],
                       *[F.col("_found")[m].alias(m) for m in made])
