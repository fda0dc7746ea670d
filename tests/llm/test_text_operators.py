"""Operators on texts against brute force, on small tables with awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plainread.llm import (
    byte_bpe,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    suffix_dedup,
    toxicity,
)
from plainread.llm.common import keyed

#: Extra columns named like columns that operators make or use inside.
CLASHES = "score double, kept string, keep_id string, _row string, _id int, _text string, sequence_id int"
SCHEMA = f"doc_id bigint, text string, {CLASHES}"
OTHER = (0.5, "x", "y", "z", 7, "t", 3)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


LONG = words(1, 9000)
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (4, "one two three four five six"),
         (4, "one two three four five six"), (None, "one two three four five six"), (None, None),
         (5, LONG), (6, LONG), (7, LONG[:20000] + " changed"), (8, "ÄÖ  ß 　x'll 12345 \n\n\n end!"),
         (9, " "), (10, words(2, 300) + " " + words(3, 80)), (11, words(4, 300) + " " + words(3, 80)),
         (12, words(5, 200)), (13, words(5, 200) + " tail"), (14, "K MIT İ mit LICENSE"), (15, "!!! 123")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *OTHER) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    for keep in ("smallest", "largest"):
        rows = exact_dedup.copy_groups(docs, keep=keep).collect()
        assert len(rows) == len(TEXTS)
        groups = {}
        for i, t in TEXTS:
            groups.setdefault(t or "", []).append(i)
        for r in rows:
            body = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            known = [i for i in groups[body] if i is not None]
            best = (min if keep == "smallest" else max)(known) if known else None
            assert (r.keep_id, r.group_size) == (best, len(groups[body])) and r.doc_id in groups[body]
        assert sum(r.kept for r in rows) == len(groups)
        left = exact_dedup.deduplicate(docs, keep=keep)
        assert left.columns == docs.columns
        assert sorted(r.text or "" for r in left.collect()) == sorted(groups)
    assert exact_dedup.copy_groups(none).count() == exact_dedup.deduplicate(none).count() == 0


def test_exact_dedup_across_partitions(spark):
    """One group that is nearly all rows spans many partitions and chunks."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 10 > 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = exact_dedup.copy_groups(rows, keep="largest")
        same = got.filter("group_size = 5400")
        assert same.count() == 5400 and same.select("keep_id").distinct().collect()[0][0] == 5999
        assert got.filter("kept").count() == 6
        assert exact_dedup.deduplicate(rows).count() == 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def rank_encoding():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    return tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=dict(zip((t.as_py() for t in byte_bpe.codec(path).tokens), range(10**6))),
                             special_tokens={})


def test_byte_bpe(docs, none):
    tool = rank_encoding()
    for chunk, overlap in ((1 << 15, 1 << 10), (50, 24), (7, 2)):
        got = byte_bpe.decode(byte_bpe.encode(docs, chunk_chars=chunk, overlap_chars=overlap)).collect()
        assert len(got) == len(TEXTS)
        found = sorted((str(r.doc_id), r.decoded.decode(), r.n_tokens, bytes(r.ids)) for r in got)
        want = []
        for i, t in TEXTS:
            ids = tool.encode_ordinary(t or "")
            want.append((str(i), t or "", len(ids), np.array(ids, "<u4").tobytes()))
        assert found == sorted(want)
    assert byte_bpe.encode(none).count() == 0


def test_language_id(spark, docs, none):
    train = [("aa", f"lalo mira tesa {words(i, 3)} lamira salomi") for i in range(20)] + [
        ("bb", f"krutz gromp strak {words(i, 3)} drunk zwork") for i in range(20)] + [(None, "x")]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    assert model[0] == ["aa", "bb"]
    texts = [("lalo tesa mira", "aa"), ("strak drunk krutz", "bb"), (None, "und"), ("", "und"), ("12 !!", "und")]
    rows = language_id.predict(spark.createDataFrame(texts, "text string, score string"), *model).collect()
    assert {r.text: r.lang_pred for r in rows} == dict(texts)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.predict(docs, *model).count() == len(TEXTS)
    assert language_id.predict(none, *model).count() == 0
    empty = language_id.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in language_id.predict(docs, *empty).collect()} == {"und"}


def test_language_vectors():
    """The bundle is the sum of rotated products of letter vectors, letter by letter."""
    tool = language_id.Encoder(64, 3)
    text = language_id.letters("Ab c1 äb")
    made = tool.vectors([text, text[:3]])
    sign = {c: tool.signs[tool.number[c]].astype(int) for c in set(text.tolist())}
    want = np.zeros(64, int)
    for a, b, c in zip(text.tolist(), text[1:].tolist(), text[2:].tolist()):
        want += np.roll(sign[a], 2) * np.roll(sign[b], 1) * sign[c]
    assert (made[0] == want).all()


def test_folding():
    for written in ("1d10t", "іdіоt", "ÍDIOT", "i.d.i.o.t ", "id​iot"):
        assert " idiot" in toxicity.fold(written), written
    assert toxicity.fold("in 1984 we") == " in we "
    assert toxicity.fold("well!") == " well "


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    plain = [words(100 + i, 30) for i in range(120)]
    toxic = [words(300 + i, 15) + f" you {rng.choice(['grumpf', 'slorky'])} " + words(500 + i, 15) for i in range(60)]
    table = [(i, t) for i, t in enumerate(plain + toxic)]
    labels = [(i, int(i >= 120)) for i in range(180)] + [(999, None), (None, 1)]
    corpus = spark.createDataFrame(table, "doc_id bigint, text string")
    lexicon = toxicity.fit(corpus, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    tests = [("a grumpf here", True), ("a gruмpf here", True), ("a perfectly fine one", False), (None, False), ("", False),
             (words(7, 500) + " slorky " + words(8, 500), True)]
    rows = toxicity.score(spark.createDataFrame(tests, "text string, bad boolean"), lexicon).collect()
    assert all((r.score >= 0.3) == r.bad for r in rows)
    exempt = toxicity.Lexicon({" clown": 5.0}, ("clown fish",), (-4.0, 1.0, 1.0))
    some = toxicity.score(spark.createDataFrame([("a clown fish",), ("a clown",)], "text string"), exempt).collect()
    assert [r.n_matches for r in some] == [0, 1]
    assert toxicity.score(docs, lexicon).count() == len(TEXTS)
    assert toxicity.score(none, lexicon).count() == 0
    empty = toxicity.fit(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert not empty.weights


def removed(texts: list[str], length: int) -> list[np.ndarray]:
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] = seen.get(b[p:p + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [400, 40])
def test_suffix_dedup(spark, docs, none, length):
    rows = [*TEXTS, (20, "ab" * 600), (21, "x" * 399), (22, "y" * 401), (23, words(3, 79)), (24, "é" * 300)]
    table = spark.createDataFrame([(*r, *OTHER) for r in rows], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(table, length=length).collect()
    want = []
    for (i, t), gone in zip(rows, removed([t for _, t in rows], length)):
        body = np.frombuffer((t or "").encode(), np.uint8)
        want.append((str(i), len(body), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()),
                     body[~gone].tobytes()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_long_text(spark):
    """A text over several blocks, with a repeat across a block's border."""
    body = words(11, 2 * suffix_dedup.BLOCK // 5)
    part = body[suffix_dedup.BLOCK - 300:suffix_dedup.BLOCK + 300]
    table = spark.createDataFrame([(1, body), (2, part + " other"), (3, "q" + part[:500])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table).collect()}
    assert got[1].n_removed == 600 and got[1].n_spans == 1
    assert got[2].kept == bytearray(b" other") and got[3].kept == bytearray(b"q")


def shingle_set(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_jaccard_join(spark, docs, none):
    rng = random.Random(5)
    base = words(40, 150).split()
    near = []
    for i in range(60):  # a group of near copies, chained
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
        near.append((100 + i, " ".join(w)))
    rows = [*TEXTS, *near, *near[:5]]
    table = spark.createDataFrame([(*r, *OTHER) for r in rows], SCHEMA).repartition(3)
    got = jaccard_join.near_groups(table).collect()
    sets = [shingle_set(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        group = key if not sets[i] else min(ids, default=None)
        want.append((str(key), len(sets[i]), str(group)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(want)
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    alone = sum(1 for i, s in enumerate(sets) if not s)
    # rows that repeat an id and an empty text are one
    assert kept.count() == len({find(i) for i, s in enumerate(sets) if s}) + alone
    assert jaccard_join.near_groups(none).count() == 0


def near_rows():
    rng = random.Random(8)
    base = words(43, 60).split()
    rows = [(i, " ".join(base[:50] + [f"w{i % 9}"])) for i in range(30)] + [(100 + i, words(i, 30)) for i in range(20)]
    rows += [rows[3], rows[40], (None, rows[5][1]), (None, None), (7, ""), (7, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_jaccard_moves_neither_texts_nor_columns(spark, monkeypatch, most):
    """What goes is left out by its keys, broadcast up to a bound; beyond it the rows are the same. The copies of a class take their
    columns nowhere."""
    table = spark.createDataFrame(near_rows(), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of the size of a corpus
    written = {}
    keep = jaccard_join.materialize

    def noted(df, name="table"):
        written[name] = df
        return keep(df, name)

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    try:
        kept = jaccard_join.keep_one(table)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(kept.collect(), key=str)
        if most:
            assert "strategy=broadcast" in plan
            physical = written["columns"]._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in physical
        assert "_entered" not in written["classes"].columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len({str(r) for r in got})
    groups = jaccard_join.near_groups(table).collect()
    best = {}
    for r in groups:
        now = (r.doc_id is None, r.doc_id or 0, r._no)
        if r._root not in best or now < best[r._root][0]:
            best[r._root] = (now, (r._row, r._mark))
    keys = {k for _, k in best.values()}
    assert len(got) == len(keys)


def test_jaccard_removes_what_it_wrote(spark):
    from plainread.session import recorded

    table = spark.createDataFrame(near_rows(), "doc_id bigint, text string")
    with recorded() as outer, recorded() as paths:
        groups = jaccard_join.near_groups(table)
    assert outer == paths
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in paths if os.path.exists(p.removeprefix("file:"))]
    assert "columns" not in left and "meetings" not in left and "members" not in left and "incidence" in left
    assert groups.count() == table.count()


def test_jaccard_blocks(spark, monkeypatch):
    """Blocks of a few documents give what one block gives."""
    base = words(41, 60).split()
    rows = [(i, " ".join(base[:58] + [f"w{i}", f"v{i % 7}"])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_COLUMNS", 300)
    got = jaccard_join.near_groups(table, percent=90).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40


def test_packing(docs, none):
    path = public_tokenizers.path(packing.VOCABULARY)
    tool = Tokenizer.from_file(path)
    got = packing.pack(docs, length=64).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(str(i), []).append(tool.encode(t or "", add_special_tokens=False).ids + [2])
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 64
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for (i, n), rows in pieces.items():
        copies = [x for x in ids[i] if len(x) == n]
        if len(copies) == 1:
            rows.sort(key=lambda r: r.start)
            assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == copies[0]
    assert packing.pack(none).count() == 0


def test_packing_encodes_as_the_tokenizer():
    """Special tokens in any place and case, odd letters, and words met in any order."""
    tool = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["<|endoftext|>", "a<|endoftext|>b, <|ENDOFTEXT|> <|endoftext|>. <|startoftext|><|endoftext|>", "<|endoftext|>.",
             "<|EndOfText|>, <|endoftext|>,", "x<|endoftext|>y. X<|endoftext|>Y", "e\u0301<|endoftext|>É <|endof text|>", "İ Σας ς <|endoftext|"]
    for order in (texts, texts[::-1]):
        made = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
        for text in order:
            assert made.encode(text).tolist() == tool.encode(text, add_special_tokens=False).ids + [2], text

def test_packing_learns_variants_of_a_word_as_one():
    made = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    real, asked = made.tool, []

    class Counting:
        def encode(self, text, **options):
            asked.append(text)
            return real.encode(text, **options)

    made.tool = Counting()
    texts = ["Zebra zebra, ZEBRA. quagga", "quagga. Quagga, 12, 12 a.b. É, é Σας <|endoftext|>, zebra", "", "zebra"]
    got = [ids.tolist() for ids in made.encode_all(texts)]
    assert got == [real.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    words = " ".join(asked).lower().split(" ")
    assert words.count("zebra") == words.count("quagga") == words.count("é") == 1
    assert len(asked) == 3  # two words that are encoded alone, and all others together


def test_hilbert_curve():
    """Every cell of a small cube once, neighbours on the curve are neighbours in space."""
    side = 8
    cube = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(cube)
    order = cube[np.argsort(keys)]
    assert len(set(keys.tolist())) == side**3
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_license_scan(spark, docs, none):
    mit = license_scan.NOTICES[0][1].split()
    rows = [(1, "Under the MIT License. MIT license, CC BY"), (2, "GNU general public"), (3, "gnu General\npublic-License!"),
            (4, " ".join(mit[:8] + ["added"] + mit[8:20])), (5, None), (6, ""), (1, "Under the MIT License. MIT license, CC BY"),
            (7, "mit mit license license"), (None, "Apache License"), (8, "Émit license mit licenseé")]
    table = spark.createDataFrame([(*r, *OTHER) for r in rows], SCHEMA)
    got = {(r.doc_id): r for r in license_scan.scan(table).collect()}
    assert len(license_scan.scan(table).collect()) == len(rows)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 3, 2, 6, "cc-by,mit")
    assert (got[2].n_base, got[2].labels, got[2].first_word) == (0, "", None)
    assert (got[3].base_labels, got[3].first_word) == ("gpl", 0)
    assert got[4].base_labels == "" and got[4].labels == "mit" and 0.6 <= got[4].score < 1
    assert got[5].n_words == got[6].n_words == 0
    assert (got[7].n_base, got[7].first_word) == (1, 1) and got[None].base_labels == "apache"
    assert got[8].n_base == 0
    assert license_scan.scan(docs).count() == len(TEXTS) and license_scan.scan(none).count() == 0
    plan = license_scan.scan(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_threshold_bounds():
    for n in range(1, 200):
        need = -(-n * 85 // 100)
        assert need == math.ceil(n * 85 / 100 - 1e-9)


def test_texts_in_no_learned_language(spark):
    """Clean texts stay, short ones and one word over and over too; an unlearned language and random letters go."""
    rng = random.Random(8)
    known = {l: ["".join(rng.choices(l, k=rng.randint(2, 7))) for _ in range(60)] for l in ("abcdefgh", "ijklmnop", "abijqrst")}
    other = ["".join(rng.choices("aeioqcgkmu", k=rng.randint(2, 7))) for _ in range(60)]
    rows, stay = [], set()
    for l, vocabulary in known.items():
        for n in (1, 2, 3, 5, 20, 100, 300) * 8:
            rows.append((len(rows), " ".join(rng.choices(vocabulary, k=n)), l))
    rows.append((len(rows), " ".join(vocabulary[:1] * 300), l))
    stay = {r[0] for r in rows}
    junk = "".join(map(chr, range(97, 123)))
    # Ids of the held-out part, so that nothing is learned from them.
    ids = (i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(next(ids), " ".join(rng.choices(other, k=n)), "x") for n in (40, 100, 300)]
    rows += [(next(ids), " ".join("".join(rng.choices(junk, k=rng.randint(2, 9))) for _ in range(n)), "x") for n in (40, 400)]
    left = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "")
    assert {r.doc_id for r in left.collect()} == stay


def test_rows_without_an_id(spark):
    """Texts under null ids stay apart where their 32-bit hashes agree."""
    body = words(50, 90)
    table = spark.range(200_000).select(F.concat(F.lit(body + " "), F.col("id").cast("string"), F.lit(" end")).alias("text"))
    pair = F.array_sort(F.collect_list("text"))
    two = table.groupBy(F.hash("text")).agg(pair.alias("both")).filter("size(both) > 1").orderBy("both").first().both[:2]
    rows = [(None, two[0]), (None, two[1]), (None, words(51, 20)), (None, words(51, 20))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert docs.select(*keyed(docs, "text", "doc_id")).distinct().count() == 3
    assert jaccard_join.keep_one(docs, percent=100).count() == 3
    got = suffix_dedup.remove_repeats(docs).collect()
    want = removed([t for _, t in rows], 400)
    assert sorted(bytes(r.kept) for r in got) == sorted(
        np.frombuffer(t.encode(), np.uint8)[~gone].tobytes() for (_, t), gone in zip(rows, want))


def test_pipeline_run(spark, tmp_path):
    """run() against plain Python of its five decisions."""
    rng = random.Random(9)
    vocabularies = [["".join(rng.choices(l, k=rng.randint(2, 7))) for _ in range(60)] for l in ("abcdefgh", "ijklmnop", "abijqrst")]
    made = [(l, rng.choices(v, k=rng.randint(100, 160))) for l, v in enumerate(vocabularies) for _ in range(30)]
    for l, w in made[::9]:
        made.append((l, w))  # a copy
        made.append((l, [*w[:50], "abij", *w[51:]]))  # a near copy
        made.append((l, [*w[:60], *rng.choices(vocabularies[l], k=60), "ij"]))  # less than 0.8
    for l, w in made[4:30:6]:
        made.append((l, [*rng.choices(vocabularies[l], k=90), *w[:95], *rng.choices(vocabularies[l], k=40)]))  # a passage
    rng.shuffle(made)
    rows = [(i, " ".join(w), f"l{l}") for i, (l, w) in enumerate(made)]
    junk = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200))
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2][:3]
    gone = [(held[0], None, "l0"), (held[1], "12 !!", "l0"), (held[2], junk, "l0")]
    spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows + gone],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet"))
    best = {}
    for i, t, _ in rows:
        best[t] = max(i, best.get(t, -1))
    left = sorted((i, t) for t, i in best.items())
    sets = [shingle_set(t, 5) for _, t in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    single = [left[i] for i in range(len(left)) if root[i] == i]
    cut = removed([t for _, t in single], 400)
    assert len(rows) > len(left) > len(single) and any(g.any() for g in cut)
    tool = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for (i, t), g in zip(single, cut):
        body = np.frombuffer(t.encode(), np.uint8)[~g].tobytes().decode()
        want[i] = tool.encode(body, add_special_tokens=False).ids + [packing.END]
    got, places = {}, {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        got.setdefault(r.doc_id, []).extend(ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
    assert got == want
    for pieces in places.values():  # sequences have no gaps and are full, or a power of two
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 4096 and total & (total - 1) == 0


def test_toxicity_is_plain_matching(spark):
    """Folding, matching and the score against searches term by term, also with very many exceptions."""
    rng = random.Random(9)
    parts = ["grump", "slork", "idiot", "clown", "fish", "ab", "cd", "grumpf"]
    weights = {f" {w}{' ' * (i % 2)}": 1.0 + i / 3 for i, w in enumerate(parts)}
    lexicon = toxicity.Lexicon(weights, ("clown fish", "ab idiot cd", "fish grump"), (-2.0, 0.7, 0.4))
    rows = [" ".join(rng.choices([*parts, "x", "Cl0wn", "gr\u00fcmp", "idi0t!"], k=n)) for n in [0, 1, 2, 3, 8, 30, 200] * 6]
    rows += [None, "", "clown fish " * 20_000 + "clown"]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string"), lexicon, text="t").collect()

    def places(folded, term):
        return [(m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", folded)]

    for r in got:
        folded = toxicity.fold(rows[r.i] or "")
        spared = [p for e in lexicon.exceptions for p in places(folded, toxicity.fold(e))]
        if len(spared) > 1000:  # all but the last clown
            spared = [(0, len(folded) - len(" clown "))]
        best = {}
        for term, weight in weights.items():
            for a, b in places(folded, term):
                if not any(x <= a and b <= y + (len(spared) == 1 and len(folded) > 10_000) for x, y in spared):
                    best[a] = max(weight, best.get(a, 0.0))
        total = sum(best.values()) / math.log2(1 + folded.count(" ")) if best else 0.0
        logit = -2.0 + 0.7 * total + 0.4 * max(best.values(), default=0.0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit))) and r.n_matches == len(best)


def test_repeated_labels_of_one_document(spark):
    docs_ = spark.createDataFrame([(i, f"plain words {i} " + ("slorky" if i % 2 else "kind")) for i in range(60)], "doc_id bigint, text string")
    once = [(i, i % 2) for i in range(60)]
    one = toxicity.fit(docs_, spark.createDataFrame(once, "doc_id bigint, toxic int"))
    twice = toxicity.fit(docs_, spark.createDataFrame(once * 3, "doc_id bigint, toxic int"))
    assert one.weights == twice.weights and one.weights
    both = toxicity.fit(docs_, spark.createDataFrame([*once, (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int"))
    assert set(both.weights) == set(one.weights)


def test_language_prediction_is_the_nearest_prototype(spark):
    """Vectors bound and bundled letter by letter, prototypes and the score in plain loops."""
    rng = random.Random(4)
    letters_of = {"aa": "abcde ", "bb": "efghi ", "cc": "aeghk "}
    train = [(i, "".join(rng.choices(letters_of[lang], k=60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 5)]
    tests = [(100 + i, "".join(rng.choices(letters_of[lang] + "z", k=n)), None) for i, (lang, n) in enumerate(
        [("aa", 3), ("bb", 9), ("cc", 40), ("aa", 200), ("bb", 1)])] + [(200, None, None), (201, " 12 ", None), (202, "", None)]
    schema = "doc_id bigint, text string, lang string"
    model = language_id.fit(spark.createDataFrame(train, schema), dimensions=128)

    def vector(text):
        codes = language_id.letters(text or "")
        total = np.zeros(128)
        for t in range(len(codes) - 2):
            bound = np.ones(128)
            for i in range(3):
                sign = np.random.default_rng(int(codes[t + 2 - i])).integers(0, 2, 128, np.int8).astype(int) * 2 - 1
                bound = bound * np.roll(sign, i)
            total += bound
        return total

    def unit(v):
        return v / (np.linalg.norm(v) or 1)

    plain = np.array([unit(sum(unit(vector(t)) for _, t, g in train if g == lang)) for lang in letters_of])
    prototypes = np.array([unit(p) for p in plain - plain.mean(axis=0)])
    assert model[0] == list(letters_of) and model[1] == pytest.approx(prototypes, abs=1e-5)
    found = language_id.predict(spark.createDataFrame(tests, schema), *model, keep=["doc_id"]).collect()
    for r in found:
        v = unit(vector(next(t for i, t, _ in tests if i == r.doc_id)))
        cosines = prototypes @ v
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        assert r.lang_pred == list(letters_of)[int(cosines.argmax())]
        assert r.score == pytest.approx(1 / np.exp(20 * (cosines - cosines.max())).sum(), rel=1e-4)
    # Equal prototypes tie: the language first in order.
    same = spark.createDataFrame([(1, "abc abc", "y"), (2, "abc abc", "x")], schema)
    tied = language_id.predict(same.select("doc_id", "text"), *language_id.fit(same), keep=["doc_id"]).collect()
    assert {r.lang_pred for r in tied} == {"x"}


def test_copies_enter_the_language_sample_in_their_share(spark):
    rows = [(i, "one text many times", "aa") for i in range(3000)] + [(5000 + i, f"text {i}", "aa") for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    drawn = [r["_text"] for r in language_id.draw(table, "text", "lang", 400).collect()]
    assert 300 < len(drawn) < 500 and 200 < drawn.count("one text many times") < 400
    again = language_id.draw(table.union(table).drop("doc_id"), "text", "lang", 100_000)
    assert again.count() == 1001  # rows alike in all columns count once


def test_many_templates_are_not_broadcast(spark, monkeypatch):
    """The same labels when the templates are shuffled by hash."""
    table = spark.createDataFrame([(1, "under the MIT license and cc by"), (2, "no licence"), (3, None),
                                   (4, "licensed under the apache license version 2.0 or the gnu general public license")],
                                  "doc_id bigint, text string")
    want = sorted(map(str, license_scan.scan(table).collect()))
    monkeypatch.setattr(license_scan, "BROADCAST_WORDS", 10)
    many = license_scan.scan(table)
    assert sorted(map(str, many.collect())) == want and any("mit" in r for r in want)
