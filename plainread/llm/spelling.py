"""Spelling variants by a trie over letter frequencies.

Letters fall into ``LEVELS`` groups; a word's vector is how many of its letters lie in each, and the trie
arranges words by these counts, group after group, the group whose counts vary most first.  A word one
letter away from another has a surplus of one letter in at most one group and a deficit of one in at most
one.  The search goes down the trie depth first with a budget of one surplus and one deficit; the words
of the leaves it reaches are verified.  The surplus must be spent first, so each pair is met from one side
only: from the shorter word, or the one that is first in the trie's order.

The trie is spread over the cluster in cells, subtrees of at most ``CELL`` words.  Above the cells Spark
goes down level by level: a word with its budgets is joined with the children that exist.  Inside a cell
a task builds the subtree and searches it.  A leaf above ``CELL`` words is dealt out in chunks, and a cell
that many words ask is repeated for slices of them, so neither meets in one task.  Tasks return how many
near words a word has and the best of them, never the pairs.

Defined results: null texts have no words; a null id counts as an empty one where typing slips are planted;
repeated rows count as often as they occur; among near words of one count the first in code-point order is
taken; an empty table, or one without words frequent enough, gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import each
from plainread.session import materialize

LEVELS = 16
#: Words of a subtree one task holds at a time, and how many of those that search it.
CELL, ASKING = 8192, 65536
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
SLICE = 1 << 20
HELD = 200_000
#: Words of a subtree that are compared one by one.
SMALL = 6
#: The character of a count of none.
ZERO = 48
LETTER = re.compile("[A-Za-zÀ-ÿ]")


def runs(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    """Words of a text, A-Z lower-cased, slice by slice; slices are cut beside what is no letter."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + SLICE)
        while end < len(text) and LETTER.match(text, end):
            end += 1
        yield pattern.findall(text[begin:end].encode("utf-8", "replace").lower().decode())
        begin = end


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` letters and ``least_count`` occurrences.

    With ``slips`` typing slips are planted: h is the crc32 of "<id>:<word>"; where ``slips`` divides
    it, letter h % length of the word (from 0) is left out, in all its places in that document.
    """
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("_id"),
                       F.col(f"`{text}`").alias("_text"))
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, value in zip(each(batch.column("_id")), each(batch.column("_text"))):
                own: Counter = Counter()
                for words in runs(value, pattern):
                    own.update(words)
                if slips:
                    begin = zlib.crc32(f"{name}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % slips == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1:]
                        total[word] += n
                else:
                    total.update(own)
                if len(total) > HELD:
                    yield counted(total)
                    total.clear()
        if total:
            yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                           pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def with_paths(words: DataFrame) -> DataFrame:
    """(word, n, _path, _up, _down): the counts of its letter groups, the group that varies most first, a
    character a count; and the same with one more and one less of each."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.bincount(np.frombuffer(w.encode("utf-32-le"), np.uint32) % LEVELS, minlength=LEVELS)
                    for w in each(batch.column("word"))]
            flat = pa.array(np.concatenate([np.empty(0, int), *made]).astype(np.int32))
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * LEVELS)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"),
                                              pa.ListArray.from_arrays(offsets, flat)], ["word", "n", "_counts"])

    found = materialize(words.mapInArrow(vectors, "word string, n bigint, _counts array<int>"), "vectors")
    spread = found.agg(*[F.var_pop(F.col("_counts")[i]).alias(f"v{i}") for i in range(LEVELS)]).first()
    order = sorted(range(LEVELS), key=lambda i: -(spread[i] or 0.0))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch.column("_counts").flatten()).reshape(-1, LEVELS)[:, order]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), *[pa.array(characters(counts + by), pa.string()) for by in (0, 1, -1)]],
                ["word", "n", "_path", "_up", "_down"])

    return materialize(found.mapInArrow(written, "word string, n bigint, _path string, _up string, _down string"), "paths")


def characters(counts: np.ndarray) -> list[str]:
    """Rows of counts as texts, in the same order as the counts."""
    codes = counts.astype(np.uint32) + np.uint32(ZERO)
    codes[codes >= 0xD800] += np.uint32(0x800)  # what are no characters is left out
    return np.ascontiguousarray(codes).view(f"<U{LEVELS}").ravel().tolist()


def reached(words: DataFrame, cell: int) -> DataFrame:
    """(word, n, _path, _plus, _minus, _node, _size): the cells each word reaches with the budgets it has
    left there.  With both budgets whole the cell is its own."""
    level = 0
    front = words.select("word", "n", "_path", "_up", "_down", F.lit(1).alias("_plus"), F.lit(1).alias("_minus"),
                         F.lit("").alias("_node"))
    kept = ["word", "n", "_path", "_plus", "_minus", "_node", "_size"]
    found = None
    while True:
        sizes = words.groupBy(F.substring("_path", 1, level).alias("_node")).agg(F.count("*").alias("_size"))
        met = materialize(front.join(sizes, "_node").select(*kept, "_up", "_down"), "cells")
        whole = (F.col("_size") <= cell) | F.lit(level == LEVELS)
        done = met.filter(whole).select(*kept)
        found = done if found is None else found.union(done)
        open_ = met.filter(~whole)
        if open_.isEmpty():
            return found
        plus, minus = F.col("_plus"), F.col("_minus")
        none = F.lit(None).cast("struct<_next:string,_plus:int,_minus:int>")

        def step(at: str, more, less):
            return F.struct(F.substring(at, level + 1, 1).alias("_next"), more.alias("_plus"), less.alias("_minus"))

        steps = F.array(step("_path", plus, minus),
                        F.when(plus == 1, step("_up", F.lit(0), minus)).otherwise(none),
                        F.when((plus == 0) & (minus == 1), step("_down", plus, F.lit(0))).otherwise(none))
        gone = open_.select("word", "n", "_path", "_up", "_down", "_node",
                            F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("_s"))
        front = gone.select("word", "n", "_path", "_up", "_down", F.col("_s._plus").alias("_plus"),
                            F.col("_s._minus").alias("_minus"), F.concat("_node", "_s._next").alias("_node"))
        level += 1


def one_apart(a: str, b: str) -> bool:
    """Whether b differs from a by one replaced or one inserted letter."""
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


class Leaf:
    """Many words of one vector, hence of one length, looked up by either half."""

    def __init__(self, entries: list[tuple[str, str, int]]) -> None:
        self.length = len(entries[0][1])
        self.halves: dict = {}
        for _, word, n in entries:
            for key in ((0, word[:self.length // 2]), (1, word[self.length // 2:])):
                self.halves.setdefault(key, []).append((word, n))

    def candidates(self, word: str) -> set[tuple[str, int]]:
        half = self.length // 2
        tail = half - (self.length - len(word))
        return {*self.halves.get((0, word[:half]), ()), *self.halves.get((1, word[tail:]), ())}


def grown(entries: list[tuple[str, str, int]], level: int):
    """The subtree of sorted (path, word, n): dicts by count; few words stay a list, many of one vector are a leaf."""
    if len(entries) <= SMALL:
        return entries
    if level == LEVELS:
        return Leaf(entries)
    edges = [0, *(i for i in range(1, len(entries)) if entries[i][0][level] != entries[i - 1][0][level]), len(entries)]
    return {entries[a][0][level]: grown(entries[a:b], level + 1) for a, b in zip(edges, edges[1:])}


def near(tree, level: int, word: str, path: str, plus: int, minus: int) -> Iterator[tuple[str, int]]:
    """Words of a subtree one letter away, each pair from one side."""
    stack = [(tree, level, plus, minus)]
    size = len(word)
    while stack:
        node, level, plus, minus = stack.pop()
        kind = type(node)
        if kind is dict:
            here = path[level]
            if (kid := node.get(here)) is not None:
                stack.append((kid, level + 1, plus, minus))
            if plus:
                if (kid := node.get(shifted(here, 1))) is not None:
                    stack.append((kid, level + 1, 0, minus))
            elif minus and (kid := node.get(shifted(here, -1))) is not None:
                stack.append((kid, level + 1, plus, 0))
        elif kind is list:
            for other_path, other, n in node:
                # The first in the trie's order asks; of one vector the smaller word.
                if 0 <= len(other) - size <= 1 and (other_path > path or other_path == path and word < other) and (
                        one_apart(word, other)):
                    yield other, n
        else:
            for other, n in node.candidates(word):
                if (not (plus and minus) or word < other) and one_apart(word, other):
                    yield other, n


@lru_cache(4096)
def shifted(character: str, by: int) -> str:
    code = ord(character) + by
    return chr(code + 0x800 * by if 0xD800 <= code < 0xE000 else code)


def near_words(words: DataFrame, cell: int = CELL, asking: int = ASKING) -> DataFrame:
    """(word, n_near, _best): how many words of ``words`` (word, n) are one letter away, and the
    best of them as (minus its n, word); words without any are left out."""
    found = materialize(reached(with_paths(words), cell), "reached")
    chunks = F.ceil(F.col("_size") / cell).cast("int")
    asked = found.groupBy("_node").agg(F.ceil(F.count("*") / asking).cast("int").alias("_slices"))
    rows = found.join(asked, "_node")
    number = F.xxhash64("word")
    columns = ["_node", "word", "n", "_path", "_plus", "_minus"]
    # Words of a cell, a copy for each slice of those that ask; and those that ask, in each chunk of a leaf.
    held = rows.filter("_plus = 1 and _minus = 1").select(
        *columns, F.lit(True).alias("_held"), F.pmod(number, chunks).cast("int").alias("_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    asks = rows.select(*columns, F.lit(False).alias("_held"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"),
                       F.pmod(number, F.col("_slices")).cast("int").alias("_slice"))
    key = ["_node", "_chunk", "_slice"]
    laid = held.unionByName(asks).repartition(*key).sortWithinPartitions(*key, F.col("_held").desc())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, tree, best = None, [], None, {}

        def meet(word: str, other: str, n: int) -> None:
            times, least = best.get(word, (0, (1, "")))
            best[word] = (times + 1, min(least, (-n, other)))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "_held", "word", "n", "_path", "_plus", "_minus")]
            for *place, held, word, n, path, plus, minus in zip(*columns):
                if place != now:
                    if best:
                        yield partial(best)
                    now, entries, tree, best = place, [], None, {}
                if held:
                    entries.append((path, word, n))
                elif entries:
                    tree = tree or grown(sorted(entries), len(place[0]))
                    for other, m in near(tree, len(place[0]), word, path, plus, minus):
                        meet(word, other, m)
                        meet(other, word, n)
        if best:
            yield partial(best)

    def partial(best: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.int64()),
             pa.array([b[1][0] for b in best.values()], pa.int64()),
             pa.array([b[1][1] for b in best.values()], pa.string())], ["word", "_times", "_n", "_other"])

    pairs = laid.mapInArrow(search, "word string, _times bigint, _n bigint, _other string")
    return pairs.groupBy("word").agg(F.sum("_times").alias("n_near"),
                                     F.min(F.struct("_n", "_other")).alias("_best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where following forms ends, by doubling the steps."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        steps = materialize(steps.join(on, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        if steps.filter("_moved").isEmpty():
            return steps.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, times: int = TIMES, slips: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word.

    Two words are near if one letter inserted, left out or replaced makes one the other.  A word's
    form is its most frequent near word, if that occurs ``times`` as often at least; its root is
    where forms of forms end.
    """
    words = materialize(word_counts(docs, text, doc_id, least_length, least_count, slips), "words")
    near = near_words(words)
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("_best._n") >= times * F.col("n"), F.struct(
            F.col("_best._other").alias("form"), (-F.col("_best._n")).alias("form_n"))).alias("_form")).select(
        "word", "n", "n_near", "_form.form", "_form.form_n"), "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
