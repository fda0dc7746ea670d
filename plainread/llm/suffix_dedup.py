"""Repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  Full prefix
doubling sorts a (position, rank) pair for every byte of the corpus in every round.  Here the first
round sorts a content-chosen sample of positions, and only what can still repeat is sorted at the
doubled offset:

1. Ranks start at half the threshold.  The rank of a string is its 64-bit hash, so ranks need no
   renumbering.  Each window of ``length`` bytes names one anchor: the position in it whose
   half-length string has the smallest hash.  Equal windows name equal anchors.  Neighbouring windows
   with one anchor form a run, about ``length`` / 4 windows, and the run's bytes get a rank as well.
2. Spark sorts (anchor rank, run rank, position).  A row unlike both neighbours in its anchor rank is
   unique: its windows occur once.  A row like a neighbour in both ranks repeats wholly.
3. The windows of the other runs, with one representative of each whole run beside them, are sorted
   by (rank at p, rank at p + length / 2), which is the doubled offset and reaches the threshold.  A
   row like a neighbour repeats; the others are unique.

Rows that open or close a sorted partition have a neighbour elsewhere: in step 2 they go on to step
3, where the border rows, two a partition, are compared by a join.  Sort keys end with the position,
so a string with any number of copies spreads over many tasks.

Defined results: null texts count as empty; texts shorter than ``length`` keep all bytes; a row that
repeats another's id and text is another document, so both lose all that is long enough; an empty
table gives an empty table; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainread.llm.common import carried, keyed, unpacked
from plainread.session import materialize

LENGTH = 400
BLOCK = 1 << 19
PLACE = (1 << 20) - 1
KEY = ["_row", "_mark"]


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd base and of its inverse, modulo 2^64."""
    random = np.random.default_rng(20)
    values = random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15

    def run(b: int) -> np.ndarray:
        out = np.full(2 * BLOCK, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return values, run(base), run(pow(base, -1, 1 << 64))


def prefix_sums(block: np.ndarray) -> np.ndarray:
    values, up, _ = powers()
    out = np.empty(len(block) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[block] * up[:len(block)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def ranks(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    return mixed((sums[size:] - sums[:-size]) * powers()[2][:len(sums) - size])


def anchors(block: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor rank, run rank) of each run in a block of at most
    2 * BLOCK bytes; ``valid`` tells which windows lie in one document."""
    half = length // 2
    reach = length - half + 1
    sums = prefix_sums(block)
    hashes = ranks(sums, half)
    least = (hashes & ~np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    size, windows = 1, len(block) - length + 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:windows], least[reach - size:reach - size + windows])
    place = (least & np.uint64(PLACE)).astype(np.int64)
    place[~valid[:windows]] = -1
    begin = np.flatnonzero(np.diff(place, prepend=-2))
    count = np.diff(begin, append=windows)
    keep = place[begin] >= 0
    begin, count = begin[keep], count[keep]
    end = begin + count + length - 1
    run = (sums[end] - sums[begin]) * powers()[2][begin]
    # The length and the anchor's place belong to the run's identity.
    run = mixed(run + mixed((count * 4096 + place[begin] - begin).astype(np.uint64)))
    return begin, count, hashes[place[begin]], run


def pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of bytes: (block, valid windows, row of each piece, (place in block, place in text))."""
    column = batch.column("_bytes")
    parts, rows, places, total = [], [], [], 0

    def block():
        data = np.concatenate(parts)
        valid = np.zeros(len(data), bool)
        for part, (at, _) in zip(parts, places):
            valid[at:at + len(part) - length + 1] = True
        return data, valid, np.array(rows), np.array(places)

    for i in range(batch.num_rows):
        data = np.frombuffer(column[i].as_buffer(), np.uint8)
        for begin in range(0, len(data) - length + 1, BLOCK):
            part = data[begin:begin + BLOCK + length - 1]
            if total + len(part) > 2 * BLOCK - length:
                yield block()
                parts, rows, places, total = [], [], [], 0
            parts.append(part)
            rows.append(i)
            places.append((total, begin))
            total += len(part)
    if parts:
        yield block()


def anchor_runs(rows: DataFrame, length: int) -> DataFrame:
    """(_row, _mark, _from, _count, _anchor, _run): windows _from .. _from + _count - 1 of a text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (np.asarray(batch.column(k)) for k in KEY)
            for data, valid, row, place in pieces(batch, length):
                begin, count, anchor, run = anchors(data, valid, length)
                piece = np.searchsorted(place[:, 0], begin, "right") - 1
                owner = row[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner]), pa.array(marks[owner]),
                     pa.array(begin - place[piece, 0] + place[piece, 1]),
                     pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(run.view(np.int64))],
                    [*KEY, "_from", "_count", "_anchor", "_run"])

    return rows.mapInArrow(find, "_row bigint, _mark bigint, _from bigint, _count int, _anchor bigint, _run bigint")


def sorted_by(table: DataFrame, *columns: str) -> DataFrame:
    return table.repartitionByRange(*columns).sortWithinPartitions(*columns)


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Batches that overlap by a row at either end, and whether each opens or closes the partition."""
    held, opens = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is None:
            held = batch
            continue
        # Carry the last two rows on: one is judged next, one is its neighbour.
        table = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        yield table, opens, False
        held, opens = table.slice(table.num_rows - 2), False
    if held is not None:
        yield held, opens, True


def alike(columns: list[np.ndarray]) -> np.ndarray:
    """Whether row i equals row i + 1."""
    same = np.ones(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    return same


def judged(size: int, opens: bool, closes: bool) -> slice:
    return slice(0 if opens else 1, size if closes else size - 1)


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(_row, _mark, _from, _count, _whole, _look) of runs whose anchor repeats: _whole repeats as it
    is; the windows of _look are to be sorted."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, opens, closes in with_neighbours(batches):
            anchor, run = (np.asarray(batch.column(c)) for c in ("_anchor", "_run"))
            a, r = alike([anchor]), alike([anchor, run])
            # What lies beyond the partition's border might be alike.
            a_before, a_after = np.r_[opens, a], np.r_[a, closes]
            r_before, r_after = np.r_[False, r], np.r_[r, False]
            whole = r_before | r_after
            other = (a_before & ~r_before) | (a_after & ~r_after)
            look = np.where(whole, other, a_before | a_after)
            take = np.zeros(len(whole), bool)
            part = judged(len(whole), opens, closes)
            take[part] = (whole | look)[part]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(pa.array(take)) for c in (*KEY, "_from", "_count")],
                 pa.array(whole[take]), pa.array(look[take])],
                [*KEY, "_from", "_count", "_whole", "_look"])

    return sorted_by(runs, "_anchor", "_run", "_row", "_from").mapInArrow(
        judge, "_row bigint, _mark bigint, _from bigint, _count int, _whole boolean, _look boolean")


def windows(joined: DataFrame, length: int) -> DataFrame:
    """(_row, _mark, _at, _first, _second): both half-length ranks of each window of ``_runs``."""
    half = length // 2

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("_bytes")[i].as_buffer(), np.uint8)
                found = batch.column("_runs")[i].values
                for begin, count in zip(found.field("_from").to_pylist(), found.field("_count").to_pylist()):
                    h = ranks(prefix_sums(data[begin:begin + count + length - 1]), half)
                    out[0].append(np.full(count, batch.column("_row")[i].as_py()))
                    out[1].append(np.full(count, batch.column("_mark")[i].as_py(), np.int64))
                    out[2].append(np.arange(begin, begin + count))
                    out[3].append(h[:count].view(np.int64))
                    out[4].append(h[half:half + count].view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 [*KEY, "_at", "_first", "_second"])

    return joined.mapInArrow(rank, "_row bigint, _mark bigint, _at bigint, _first bigint, _second bigint")


def repeated_windows(found: DataFrame) -> DataFrame:
    """(_row, _mark, _at) of the windows that occur again."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch, opens, closes in with_neighbours(batches):
            same = alike([np.asarray(batch.column(c)) for c in ("_first", "_second")])
            again = np.r_[False, same] | np.r_[same, False]
            border = np.zeros(len(again), bool)
            border[0], border[-1] = opens, closes
            if len(again) == 1:
                border[0] = opens or closes
            take = np.zeros(len(again), bool)
            span = judged(len(again), opens, closes)
            take[span] = (again | border)[span]
            chosen = batch.filter(pa.array(take))
            inner = pa.array(~border[take])  # only border rows need their ranks again
            first, second = (pc.if_else(inner, None, chosen.column(c)) for c in ("_first", "_second"))
            yield pa.RecordBatch.from_arrays(
                [*map(chosen.column, (*KEY, "_at")), first, second, pa.array(again[take]), pa.array(border[take]),
                 pa.array(np.full(int(take.sum()), part))],
                [*chosen.schema.names, "_again", "_border", "_part"])

    made = materialize(sorted_by(found, "_first", "_second", "_row", "_at").mapInArrow(
        judge, "_row bigint, _mark bigint, _at bigint, _first bigint, _second bigint, _again boolean, "
        "_border boolean, _part bigint"), "windows")
    borders = made.filter("_border")
    met = borders.groupBy("_first", "_second").agg(F.countDistinct("_part").alias("_n")).filter("_n > 1")
    beyond = borders.filter("not _again").join(met, ["_first", "_second"], "left_semi")
    return made.filter("_again").select(*KEY, "_at").union(beyond.select(*KEY, "_at"))


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   length: int = LENGTH) -> DataFrame:
    """(_row, _mark, _spans): of each text with repeats, (from, count) of its repeated windows."""
    rows = docs.select(*keyed(docs, text, doc_id),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes")).filter(
        F.octet_length("_bytes") >= length)
    runs = materialize(anchor_runs(rows, length), "anchors")
    found = materialize(repeated_runs(runs), "runs")
    look = found.filter("_look").groupBy(*KEY).agg(F.collect_set(F.struct("_from", "_count")).alias("_runs"))
    # Copies under one id and text are sorted as often as they occur.
    again = repeated_windows(windows(rows.join(look, KEY), length))
    spans = found.filter("_whole").select(*KEY, "_from", "_count").union(
        again.select(*KEY, "_at", F.lit(1).alias("_count")))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("_from", "_count")).alias("_spans"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` with kept (binary: the remaining bytes, concatenated), n_bytes, n_removed and
    n_spans (maximal removed runs).  ``as_text`` gives kept as a string, without the bytes of
    characters that were cut through."""
    spans = repeated_spans(docs, text, doc_id, length)
    tagged = docs.select(*keyed(docs, text, doc_id), F.struct("*").alias("_doc"),
                         F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, n_spans = [], [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("_bytes")[i].as_buffer(), np.uint8)
                spans = batch.column("_spans")[i]
                sizes.append(len(data))
                if not spans.is_valid:
                    kept.append(data.tobytes())
                    removed.append(0)
                    n_spans.append(0)
                    continue
                begin = np.asarray(spans.values.field("_from"))
                end = begin + np.asarray(spans.values.field("_count")) + length - 1
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept.append(data[~gone].tobytes())
                removed.append(int(gone.sum()))
                n_spans.append(int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum()))
            if as_text:
                remaining = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            else:
                remaining = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), remaining, pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())],
                ["_doc", "kept", "n_bytes", "n_removed", "n_spans"])

    made = tagged.join(spans, KEY, "left").select("_doc", "_bytes", "_spans").mapInArrow(
        cut, carried(tagged, "_doc", f"kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint"))
    return unpacked(made, "_doc", docs.columns, ["kept", "n_bytes", "n_removed", "n_spans"])
