"""Near duplicates by SimHash and covering locality-sensitive hashing.

A document's fingerprint has a bit for each bit of a 64-bit hash: 1 if it is set in more than half of the
hashes of its word shingles, repeats included.  Documents link if their fingerprints differ in at most
``RADIUS`` bits.

Candidates come from covering hashing (Pagh, 2016).  Every bit position has a vector of RADIUS + 1 bits, and
every such vector but zero gives a table: the mask of the positions whose vector has an odd number of
ones in common with it.  The vectors of RADIUS positions span less than the whole space, so some table
leaves out all of them: two fingerprints within the radius agree under its mask.  No pair is missed, whatever
the data.

Fingerprints are classes first, so copies count once.  Classes are sorted by (table, masked fingerprint) over
the cluster.  A bucket of up to ``BUCKET`` classes within a task is compared there, all in one matrix of
differing bits, of which a forest leaves the task.  Larger buckets, and those at the border of a sorted
partition, go on to a finer round: tables over the positions their mask leaves free.  After ``ROUNDS`` rounds
few positions are free, so few fingerprints can share a bucket, and all of them meet.

Defined results: null texts, and texts without words, have the fingerprint zero and link like any other; with
fewer words than a shingle the whole sequence is one; rows that repeat an id are rows of their own; null
ids form no smallest id unless a group has no other; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import each, type_of
from plainread.llm.components import components
from plainread.session import materialize

WORDS, SEED = 3, 42
RADIUS = 3
BITS = 64
#: Classes of a bucket that are compared in one task at once.
BUCKET = 2048
ROUNDS = 3
SLICE = 1 << 20
SPACE = b" \t\n\v\f\r"


def word_slices(text: str) -> Iterator[list[bytes]]:
    """Words between ASCII white space, A-Z lower-cased, slice by slice of the text."""
    data = text.encode("utf-8", "replace").lower()
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + SLICE)
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[begin:end].split()
        begin = end


def fingerprint(text: str, size: int = WORDS, seed: int = SEED) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    held: list[bytes] = []
    any_full = False

    def count(hashes: list[int]) -> None:
        nonlocal total
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for words in word_slices(text):
        words = held + words
        if len(words) >= size:
            any_full = True
            row = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.r_[0, ends[:-1] + 1]
            hash_ = xxhash.xxh64_intdigest
            count([hash_(row[a:b], seed) for a, b in zip(begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())])
        held = words[max(0, len(words) - size + 1):]
    if held and not any_full:
        count([xxhash.xxh64_intdigest(b" ".join(held), seed)])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(_id, _print) of each row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in each(batch.column("_text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made.view(np.int64))], ["_id", "_print"])

    return rows.mapInArrow(make, f"_id {type_of(rows, '_id')}, _print bigint")


def masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the ``free`` positions: of any ``radius`` of them some mask has none."""
    size = 2 ** (radius + 1)
    vectors, number = {}, 0
    for bit in range(BITS):
        if free >> bit & 1:
            vectors[bit] = 1 + number % (size - 1)
            number += 1
    return [sum(1 << bit for bit, v in vectors.items() if (v & table).bit_count() % 2) for table in range(1, size)]


def dealt(prints: DataFrame, radius: int) -> DataFrame:
    """(_mask, _key, _print) in every table, from (_mask, _print): ``_mask`` are the positions in which the
    fingerprints already agree, to which each table adds its own."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            fixed, own = (np.asarray(batch.column(c)).view(np.uint64) for c in ("_mask", "_print"))
            for mask in np.unique(fixed):
                if int(mask) not in known:
                    free = ~int(mask) & (1 << BITS) - 1
                    known[int(mask)] = np.array([int(mask) | m for m in masks(free, radius)], np.uint64)
                here = own[fixed == mask]
                for table in np.unique(known[int(mask)]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(here), table).view(np.int64)), pa.array((here & table).view(np.int64)),
                         pa.array(here.view(np.int64))], ["_mask", "_key", "_print"])

    return prints.mapInArrow(deal, "_mask bigint, _key bigint, _print bigint")


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what is within the radius, one fewer than a component has members."""
    size = len(prints)
    label = np.arange(size)
    near = np.empty((size, size), bool)
    for low in range(0, size, 256):
        near[low:low + 256] = np.bitwise_count(prints[low:low + 256, None] ^ prints[None, :]) <= radius
    while True:
        least = np.array([label[row].min() for row in near])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(size)
    return prints[moved], prints[label[moved]]


def bucket_links(rows: DataFrame, radius: int, bucket: int, whole: bool) -> DataFrame:
    """(_a, _b, _mask): links found in the buckets of sorted rows, _mask null; and fingerprints _a, _b null, of
    buckets that need a finer round, with the mask they agree under.  ``whole``: no bucket needs one."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the bucket that may go on, and whether some of it lies elsewhere.
        held, parted = np.empty((3, 0), np.int64), not whole
        for batch in batches:
            now = np.stack([np.asarray(batch.column(c)) for c in ("_mask", "_key", "_print")])
            if not now.shape[1]:
                continue
            laid = np.concatenate([held, now], axis=1)
            begin = np.flatnonzero(np.r_[True, (laid[:2, 1:] != laid[:2, :-1]).any(axis=0)])
            if len(begin) > 1:
                yield from judged(laid, begin, parted)
                parted = False
            held = laid[:, begin[-1]:]
            if held.shape[1] > bucket and not whole:
                yield later(held)
                held, parted = held[:, :1], True
        if held.shape[1] and whole:
            yield from judged(held, np.array([0, held.shape[1]]), False)
        elif held.shape[1]:
            yield later(held)

    def judged(laid: np.ndarray, begin: np.ndarray, parted: bool) -> Iterator[pa.RecordBatch]:
        """Buckets between the places ``begin``; of the first, ``parted``, some rows lie elsewhere."""
        prints, sizes, begin = laid[2].view(np.uint64), np.diff(begin), begin[:-1]
        if parted:
            yield later(laid[:, :sizes[0]])
            sizes, begin = sizes[1:], begin[1:]
        two = begin[sizes == 2]
        left, right = prints[two], prints[two + 1]
        near = np.bitwise_count(left ^ right) <= radius
        found = [(left[near], right[near])]
        for at, size in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if size > bucket and not whole:
                yield later(laid[:, at:at + size])
            else:
                found.append(forest(prints[at:at + size], radius))
        a, b = (np.concatenate(c).view(np.int64) for c in zip(*found))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names)

    def later(laid: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(laid[2]), pa.nulls(laid.shape[1], pa.int64()), pa.array(laid[0])], names)

    names = ["_a", "_b", "_mask"]
    return rows.mapInArrow(compare, "_a bigint, _b bigint, _mask bigint")


def print_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(_a, _b): links that connect the distinct fingerprints (_print) within the radius."""
    open_, links = prints.select(F.lit(0).cast("bigint").alias("_mask"), "_print"), None
    for number in range(1, ROUNDS + 1):
        last, key = number == ROUNDS, ["_mask", "_key", "_print"]
        rows = dealt(open_, radius)
        laid = (rows.repartition("_mask", "_key").sortWithinPartitions(*key) if last
                else rows.repartitionByRange(*key).sortWithinPartitions(*key))
        found = materialize(bucket_links(laid, radius, bucket, last), "buckets")
        own = found.filter("_b is not null").select("_a", "_b")
        links = own if links is None else links.union(own)
        open_ = found.filter("_b is null").select("_mask", F.col("_a").alias("_print")).distinct()
        if last or open_.isEmpty():
            return links


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS,
                radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(<doc_id>, fingerprint, component_id): component_id is the smallest id reached by links."""
    table = materialize(fingerprints(docs, text, doc_id, words), "fingerprints")
    classes = materialize(table.groupBy("_print").agg(F.min("_id").alias("_least")), "classes")
    linked = components(print_links(classes, radius, bucket)).withColumnRenamed("_node", "_print")
    grouped = classes.join(linked, "_print", "left").select(
        "_print", F.coalesce("_root", "_print").alias("_root"), "_least")
    groups = grouped.groupBy("_root").agg(F.min("_least").alias("_group"))
    named = grouped.join(groups, "_root").select("_print", "_group")
    return table.join(named, "_print").select(
        F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_group").alias("component_id"))
