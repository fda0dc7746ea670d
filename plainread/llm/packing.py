"""Packing of documents into training sequences along a space-filling curve.

A document's token counts, hashed to a few hundred cells, are projected to three dimensions by fixed
random directions; its key is the place of that point on a Hilbert curve.  Spark range-sorts the
documents by the key, so each partition holds a stretch of the curve, and packs its tokens in that
order: sequences hold neighbouring documents.  A sequence is full, and what a partition is left with
goes into sequences of falling powers of two, so nothing is padded when the length is a power
of two.  Equal documents have equal keys and spread by id and row number.

Defined results: null and empty texts are the end token alone; repeated rows are packed each; rows
with null ids are packed like others; an empty table gives no piece; other columns are ignored.
Documents are cut freely; each token lies in exactly one piece.  Strings of the vocabulary's special tokens in
a text get the special ids, as the tokenizer gives them.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plainread.llm.common import remembered, texts, type_of
from plainread.session import materialize

VOCABULARY = "word_bpe_49k.json"
END = 2
LENGTH = 4096
CELLS = 256
BITS = 16
#: Bounds of a generation of remembered words: words, and their characters.
CACHE, CACHED_CHARS = 500_000, 1 << 23
#: Characters of texts whose new words are learned together.
BLOCK_CHARS = 1 << 13
DIRECTIONS = np.random.default_rng(7).standard_normal((CELLS, 3))


class Encoder:
    """Ids of a text.  No token crosses white space, so words between blanks or line ends, a part
    of all white space, are encoded alone and remembered: in two generations, of which the older is
    dropped when the younger is full."""

    def __init__(self, path: str) -> None:
        self.tool = Tokenizer.from_file(path)
        #: Strings of the vocabulary's own tokens: each is one id wherever it stands, also inside a word.
        self.special = [t.content.lower() for t in self.tool.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.closing = {c: np.array(self.tool.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ",."}

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text.  Words new to a block of texts are learned together."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(text.replace("\n", " ").split(" "))
            chars += len(text)
            if chars > BLOCK_CHARS:
                yield from self.block(held)
                held, chars = [], 0
        yield from self.block(held)

    def block(self, held: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > CACHE or self.chars > CACHED_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        if new := set().union(*held).difference(self.known):
            self.learn(list(new))
        return [np.append(np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4"), np.uint32(END))
                for words in held]

    def learn(self, words: list[str]) -> None:
        """Adds words.  Words that differ in case only, or by a comma or full stop after their last letter,
        which is a token of its own, are learned as one.  What is left is encoded together, if normalising
        keeps its length, and the ids dealt out by their places."""
        known, older, closing = self.known, self.older, self.closing
        self.chars += sum(map(len, words))
        whole = " ".join(words)
        lower = whole.lower()
        # All words at once, as hardly any block has such words.
        special = any(t in lower for t in self.special)
        odd = not whole.isascii()
        plain: dict[str, bytes] = {}
        pending = []
        for word, low in zip(words, lower.split(" ")):
            if (ids := older.get(word)) is not None:
                known[word] = ids
            elif special and any(t in low for t in self.special) or odd and not keeps_length(word, low):
                known[word] = np.array(self.tool.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                tail = closing.get(low[-1:], b"")
                if tail and low[-2:-1].isalpha():
                    low = low[:-1]
                else:
                    tail = b""
                if ids := known.get(low) or older.get(low):
                    known[word] = ids + tail
                else:
                    plain[low] = b""
                    pending.append((word, low, tail))
        if plain:
            made = self.tool.encode(" ".join(plain), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in made.offsets), np.int64, len(made))
            edges = np.searchsorted(starts, np.cumsum([0, *[len(w) + 1 for w in plain]])) * 4
            raw = np.array(made.ids, "<u4").tobytes()
            plain.update(zip(list(plain), [raw[a:b] for a, b in pairwise(edges.tolist())]))
            for word, low, tail in pending:
                known[word] = plain[low] + tail


def keeps_length(word: str, low: str) -> bool:
    """Whether normalising a word, whose lower case is ``low``, keeps its length."""
    return word.isascii() or (len(low) == len(word) and "Σ" not in word and unicodedata.is_normalized("NFC", word)
                              and unicodedata.is_normalized("NFC", low))


def encoder(path: str) -> Encoder:
    """The encoder that the worker remembers from task to task."""
    return remembered(("packing", path), lambda: Encoder(path))


def points(ids: list[np.ndarray]) -> np.ndarray:
    """Places of documents in the cube, each coordinate of BITS bits."""
    counts = np.stack([np.bincount((i * np.uint32(2654435761)) >> np.uint32(24), minlength=CELLS) for i in ids])
    flat = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
    return ((np.tanh(flat @ DIRECTIONS) + 1) * ((1 << BITS - 1) - 0.5)).astype(np.int64)


def hilbert(x: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of points in rows (Skilling's transposition, 2004)."""
    x = x.T.copy()
    dims = len(x)
    bit = 1 << BITS - 1
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) > 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high, 0, swap)
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << BITS - 1
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_rows(docs: DataFrame, text: str, doc_id: str, path: str) -> DataFrame:
    """(_id, _no, _key, _ids) of each document; ids in two bytes where the vocabulary allows."""
    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
                       F.monotonically_increasing_id().alias("_no"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                ids = list(tool.encode_all(texts(batch, "_text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_no"), pa.array(hilbert(points(ids))),
                     pa.array([i.astype(width).tobytes() for i in ids], pa.binary()),
                     pa.array([int(width[-1])] * len(ids), pa.int32())],
                    ["_id", "_no", "_key", "_ids", "_width"])

    return rows.mapInArrow(
        make, f"_id {type_of(rows, '_id')}, _no bigint, _key bigint, _ids binary, _width int")


def falling_powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None,
         length: int = LENGTH) -> DataFrame:
    """One row per piece: (<doc_id>, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset);
    ids as a binary of little-endian unsigned 32-bit integers."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = materialize(curve_rows(docs, text, doc_id, path), "curve")
    kind = type_of(rows, "_id")
    names = [doc_id, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        open_, filled, out, id_type = [], 0, [], pa.int64()

        def put(owner, start: int, ids: np.ndarray, of: int, number: int, at: int) -> None:
            raw = ids.tobytes()
            out.append((owner, start, len(ids), raw, zlib.crc32(raw), of, number, at))

        def batch() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return made

        for rows_ in batches:
            id_type = rows_.column("_id").type
            for i in range(rows_.num_rows):
                width = rows_.column("_width")[i].as_py()
                ids = np.frombuffer(rows_.column("_ids")[i].as_buffer(), f"<u{width}").astype("<u4")
                owner, start = rows_.column("_id")[i].as_py(), 0
                while start < len(ids):
                    take = min(length - filled, len(ids) - start)
                    open_.append((owner, start, ids[start:start + take], len(ids)))
                    start, filled = start + take, filled + take
                    if filled == length:  # a full sequence
                        at = 0
                        for piece in open_:
                            put(*piece, sequence, at)
                            at += len(piece[2])
                        open_, filled, sequence = [], 0, sequence + 1
                if len(out) > 2000:
                    yield batch()
        sizes, at = falling_powers(filled), 0
        for owner, start, ids, of in open_:
            while len(ids):
                take = min(sizes[0] - at, len(ids))
                put(owner, start, ids[:take], of, sequence, at)
                start, ids, at = start + take, ids[take:], at + take
                if at == sizes[0]:
                    sizes, at, sequence = sizes[1:], 0, sequence + 1
        if out:
            yield batch()

    order = ["_key", "_id", "_no"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        fill, f"`{doc_id}` {kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, "
        "doc_tokens bigint, sequence_id bigint, offset bigint")
