"""Tags in context: a hidden Markov model over the tags that the rules allow for each word.

The rules give every word the tags it may have (``choices``): listed words theirs, words of open classes a few
by their ending.  The model, how tags follow each other and which words they use, is learned without
labelled text by rounds of expectation and maximisation (Baum et al., 1970): every task runs forward and
backward over its sentences and adds up expected counts, Spark sums them, the driver turns sums into
probabilities.  The likelihood never falls from round to round.  The best path of tags (Viterbi) then
replaces the rule's tag.

Words are hashed into ``cells``, so the model's size is a parameter; counts cover all sentences.  Sentences of one
length are worked on together, in blocks of bounded size.

A word of a cell without counts may have any of its tags; of equally good paths the one with the earlier tag, in
the order of ``TAGS``, is taken; empty sentences have no tags; an empty corpus gives the uniform model.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W
from plainread.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON", "DET", "ADP", "AUX", "PART", "CCONJ", "SCONJ", "NUM", "PUNCT",
        "INTJ", "X"]
CELLS, ROUNDS = 1 << 14, 4
#: Tokens worked on together.
BLOCK = 1 << 16
LEAST = 1e-300


@dataclass
class Tagger:
    start: np.ndarray  # of the first tag
    follow: np.ndarray  # tag x next tag
    emit: np.ndarray  # tag x cell
    likelihood: list[float] = field(default_factory=list)  # logarithm, before each round


def mask_of(tags: Sequence[str]) -> int:
    return sum(1 << TAGS.index(t) for t in tags)


def choices(pos: Column, lower: Column, listed: Column) -> Column:
    """Bits of the tags a word may have, from the rule's tag and whether its form is listed."""
    words = F.create_map(*[F.lit(x) for w, tags in W.AMBIGUOUS_WORDS.items() for x in (w, mask_of(tags))])
    open_ = F.create_map(*[F.lit(x) for t, tags in W.OPEN_CHOICES.items() for x in (t, mask_of(tags))])
    own = F.create_map(*[F.lit(x) for i, t in enumerate(TAGS) for x in (t, 1 << i)])
    return F.coalesce(F.try_element_at(words, lower), F.when(~listed, F.try_element_at(open_, pos)),
                      F.try_element_at(own, pos), F.lit(mask_of(["X"])))


def sentence_words(words: DataFrame, keys: Sequence[str] = ("doc_id",), cells: int = CELLS) -> DataFrame:
    """(keys, sent_id, words): (tok_idx, cell, mask, tag) of each token in order, from rows of rule-tagged
    words (keys, sent_id, tok_idx, lower, pos, listed)."""
    tag = F.coalesce(F.array_position(F.array(*map(F.lit, TAGS)), F.col("pos")) - 1, F.lit(-1)).cast("int")
    one = F.struct("tok_idx", rules.hash_bucket(F.col("lower"), cells).alias("cell"),
                   choices(F.col("pos"), F.col("lower"), F.col("listed")).alias("mask"), tag.alias("tag"))
    return words.groupBy(*keys, "sent_id").agg(F.array_sort(F.collect_list(
        F.when(F.col("tok_idx").isNotNull(), one))).alias("words"))


def blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sentences, cells, allowed, tags) of sentences of one length, arrays of length x sentences (x tags)."""
    flat = column.flatten()
    cell, mask, tag = (np.asarray(flat.field(n)) for n in ("cell", "mask", "tag"))
    allowed = (mask[:, None] >> np.arange(len(TAGS)) & 1).astype(bool)
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, int)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for low, high in zip(edges, edges[1:]):
        length = int(sizes[order[low]])
        step = max(1, BLOCK // max(1, length))
        for at in range(low, high if length else low, step):
            which = order[at:min(at + step, high)]
            places = begin[which][None, :] + np.arange(length)[:, None]
            yield which, cell[places], allowed[places], tag[places]


def first_counts(cells: np.ndarray, allowed: np.ndarray, tags: np.ndarray, out: tuple) -> float:
    """Counts to begin with: a word counts for its rule's tag, and as much again for all it may have."""
    share = allowed / np.maximum(allowed.sum(axis=2, keepdims=True), 1)
    known = tags >= 0
    share[known, tags[known]] += 1
    add_counts(cells, share, np.einsum("nbi,nbj->ij", share[:-1], share[1:]), out)
    return 0.0


def add_counts(cells: np.ndarray, share: np.ndarray, follow: np.ndarray, out: tuple) -> None:
    out[0][:] += share[0].sum(axis=0)
    out[1][:] += follow
    flat, each = cells.reshape(-1), share.reshape(-1, len(TAGS))
    for i in range(len(TAGS)):
        out[2][i] += np.bincount(flat, weights=each[:, i], minlength=out[2].shape[1])


def expected_counts(cells: np.ndarray, allowed: np.ndarray, model: Tagger, out: tuple) -> float:
    """Adds expected counts of a block to ``out`` and returns the logarithm of its likelihood."""
    seen = model.emit.T[cells] * allowed
    length = len(cells)
    ahead, scale = np.empty(seen.shape), np.empty(seen.shape[:2])
    now = model.start * seen[0]
    for t in range(length):
        if t:
            now = ahead[t - 1] @ model.follow * seen[t]
        scale[t] = np.maximum(now.sum(axis=1), LEAST)
        ahead[t] = now / scale[t][:, None]
    back, follow = np.ones(seen.shape[1:]), np.zeros(model.follow.shape)
    share = np.empty(seen.shape)
    share[-1] = ahead[-1]
    for t in range(length - 2, -1, -1):
        after = seen[t + 1] * back / scale[t + 1][:, None]
        follow += ahead[t].T @ after
        back = after @ model.follow.T
        share[t] = ahead[t] * back
    add_counts(cells, share, follow * model.follow, out)
    return float(np.log(scale).sum())


def counted(rows: DataFrame, model: Tagger | None, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all sentences, in one pass: starts, successions, words by tag, likelihood."""
    # Plain arrays, tags x (cells + tags + 1) numbers: a broadcast names its classes, which workers may not have.
    held = rows.sparkSession.sparkContext.broadcast(None if model is None else (model.start, model.follow, model.emit))
    size = len(TAGS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = (np.zeros(size), np.zeros((size, size)), np.zeros((size, cells)))
        total, now = 0.0, None if held.value is None else Tagger(*held.value)
        for batch in batches:
            for _, cell, allowed, tags in blocks(batch.column("words")):
                total += (first_counts(cell, allowed, tags, out) if now is None
                          else expected_counts(cell, allowed, now, out))
        rest = np.r_[out[0], out[1].reshape(-1), total]
        yield sums([-1, *range(size)], [rest, *out[2]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part follow each other; one is held at a time."""
        now, total = None, None
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("sums")):
                if part != now:
                    if now is not None:
                        yield sums([now], [total])
                    now, total = part, 0.0
                total = total + np.frombuffer(values.as_buffer(), float)
        if now is not None:
            yield sums([now], [total])

    def sums(parts: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())],
                                          ["part", "sums"])

    schema = "part int, sums binary"
    found = (rows.select("words").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part")
             .mapInArrow(add, schema).collect())
    held.unpersist()
    parts = {r["part"]: np.frombuffer(r["sums"], float) for r in found}
    rest = parts.get(-1, np.zeros(size + size * size + 1))
    emit = np.stack([parts.get(i, np.zeros(cells)) for i in range(size)])
    return rest[:size], rest[size:-1].reshape(size, size), emit, float(rest[-1])


def share_of(counts: np.ndarray) -> np.ndarray:
    """Rows as probabilities, uniform where nothing was counted."""
    total = counts.sum(axis=-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), 1 / counts.shape[-1])


def fit(rows: DataFrame, cells: int = CELLS, rounds: int = ROUNDS) -> Tagger:
    """The model of ``rows`` (..., words), which are read rounds + 2 times and should be written."""
    start, follow, emit, _ = counted(rows, None, cells)
    model = Tagger(share_of(start + 1), share_of(follow + 1), share_of(emit))
    history = []
    for _ in range(rounds):
        start, follow, emit, likelihood = counted(rows, model, cells)
        history.append(likelihood)
        model = Tagger(share_of(start), share_of(follow), share_of(emit))
    history.append(counted(rows, model, cells)[3])
    model.likelihood = history
    return model


def best_paths(cells: np.ndarray, allowed: np.ndarray, model: Tagger) -> np.ndarray:
    """The tag numbers (length x sentences) of the most likely path of each sentence."""
    known = model.emit.sum(axis=0)[cells][:, :, None] > 0
    with np.errstate(divide="ignore"):
        seen = np.log(np.where(known, model.emit.T[cells], 1.0 / len(TAGS)) + LEAST)
        start, follow = np.log(model.start + LEAST), np.log(model.follow + LEAST)
    seen = np.where(allowed, seen, -np.inf)
    seen[~allowed.any(axis=2)] = 0.0
    best, came = start + seen[0], np.zeros(seen.shape, np.int8)
    for t in range(1, len(cells)):
        steps = best[:, :, None] + follow[None]
        came[t] = steps.argmax(axis=1)
        best = steps.max(axis=1) + seen[t]
    out = np.empty(cells.shape, np.int8)
    out[-1] = best.argmax(axis=1)
    for t in range(len(cells) - 1, 0, -1):
        out[t - 1] = np.take_along_axis(came[t], out[t][:, None].astype(int), axis=1)[:, 0]
    return out


def tags_of(words: Column, model: Tagger) -> Column:
    """array<string>: the tags of a sentence's ``words`` by the best path."""
    names = np.array(TAGS, object)

    @F.arrow_udf("array<string>")
    def best(column: pa.Array) -> pa.Array:
        out: list[list[str] | None] = [[] for _ in range(len(column))]
        filled = column if not column.null_count else column.fill_null([])
        for which, cell, allowed, _ in blocks(filled):
            for i, path in zip(which.tolist(), best_paths(cell, allowed, model).T):
                out[i] = names[path].tolist()
        return pa.array(out, pa.list_(pa.string()))

    return best.asNondeterministic()(words)
