"""Spelling variants, Merkle manifest and covering SimHash against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plainread.llm import covering, merkle, spelling
from plainread.llm.queries import all_queries
from plainread.sources.tables import read_table

from ..conftest import SF

ODD = "doc_id bigint, text string, source string, lang string, n_chars bigint, word string, _key string, n int"


def odd_table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None if t is None else len(t), "x", "y", 1) for i, t, s in rows], ODD)


# --- spelling ----------------------------------------------------------------------

def plain_variants(rows, slips=None, least=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slips and h % slips == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    near = defaultdict(set)
    cut = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1:], i].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for words in cut.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_on_the_table(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    found = all_queries()["op11_spelling"](spark, SF)
    assert sorted(map(tuple, found.collect())) == plain_variants(map(tuple, docs.collect()), 199)


@pytest.mark.parametrize("cell,asking", [(1024, 16384), (8, 5), (1, 1)])
def test_near_words_of_few_letters(spark, cell, asking):
    """Hot leaves: words over two or three letters share few vectors; chains of forms; ties."""
    random.seed(cell)
    words = {"".join(random.choices("abq", k=random.choice([6, 6, 7, 8]))) for _ in range(250)} | {"éÉàñöü", "éÉàñöüx"}
    n = {w: random.choice([5, 6, 30, 160, 900]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    found = {r["word"]: (r["n_near"], r["_best"]["_other"]) for r in spelling.near_words(table, cell, asking).collect()}
    want = {}
    for w in words:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and
                (spelling.one_apart(w, v) and v != w if len(w) <= len(v) else spelling.one_apart(v, w))]
        if near:
            want[w] = (len(near), min(near, key=lambda v: (-n[v], v)))
    assert found == want


def test_variants_odd_rows(spark):
    rows = [(1, "Colour colour COLOUR " * 20, "a"), (None, None, None), (2, "", "a"), (3, "colr color " * 5, "a"),
            (3, "colour, color; x1y ÀÉÎõü×÷ " * 9, None), (4, "l" * 300 + "color!" + "l" * 299, "b"),
            (4, ("l" * 300 + " ") * 6 + ("l" * 299 + " ") * 40, "b")]
    found = spelling.variants(odd_table(spark, rows), slips=3)
    assert sorted(map(tuple, found.collect())) == plain_variants([r[:2] for r in rows], 3)
    assert spelling.variants(odd_table(spark, [])).collect() == []


def test_long_text_is_cut_beside_words(monkeypatch):
    text = "alpha bravos " * 50 + "q" * 40 + " Éclairs"
    whole = re.findall("[a-zÀ-ÿ]{6,}", text.lower().replace("éclairs", "Éclairs"))
    monkeypatch.setattr(spelling, "SLICE", 17)
    assert [w for part in spelling.runs(text, re.compile("[a-zÀ-ÿ]{6,}")) for w in part] == whole


# --- Merkle ------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text) if text is not None else None


def plain_proofs(rows):
    """rows (doc_id, source, lang, n_chars, text)"""
    groups = defaultdict(list)
    for row in rows:
        groups[(row[1] is not None, (row[1] or "").encode())].append(row)
    trees = {g: plain_tree([plain_leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))])
             for g in sorted(groups)}
    top = plain_tree([trees[g][-1][0] for g in trees])
    out = []
    for j, g in enumerate(trees):
        for i, row in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))):
            value, beside = plain_leaf(row), []
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                value = plain_leaf((*row[:4], lowered(row[4])))
            for levels, at in ((trees[g], i), (top, j)):
                for level in levels[:-1]:
                    begin = at // 16 * 16
                    run = level[begin:begin + 16]
                    beside += [d for k, d in enumerate(run) if k != at - begin]
                    run[at - begin] = value
                    value, at = sha("".join(run)), at // 16
            root = top[-1][0]
            out.append((row[0], plain_leaf(row), trees[g][-1][0], root, sha("".join(beside)), value, value == root))
    return sorted(out, key=str)


def proofs(docs):
    return merkle.proofs(merkle.build(docs, other=merkle.tampered_leaf(docs)))


def test_proofs_on_the_table(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = all_queries()["op12_merkle"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == plain_proofs(map(tuple, docs.collect()))


def test_proofs_of_sizes_around_runs_and_builders(spark):
    rows, doc_id = [], 0
    for source, size in [(None, 1), ("", 16), ("a", 17), ("é", 256), ("z", 257), ("Z", 300), *[(f"s{i}", 2) for i in range(20)]]:
        for _ in range(size):
            doc_id += 1
            rows.append((doc_id, source, None if doc_id % 7 == 0 else "en", doc_id, None if doc_id % 11 == 0 else f"Text {doc_id} é"))
    rows += [(5, "a", "x", 1, "Same Id"), (5, "a", "x", 1, "Same Id"), (None, "a", None, None, None)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").selectExpr(
        "*", "1 as _key", "2 as _at", "3 as root")
    assert sorted(map(tuple, proofs(docs).collect()), key=str) == plain_proofs(rows)
    empty = docs.limit(0)
    assert proofs(empty).collect() == [] and merkle.build(empty).root.collect() == []


def test_log_is_in_postorder_without_gaps(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id < 4700, 'a', 'b') as source", "'en' as lang", "1L as n_chars",
                                        "cast(id as string) as text")
    manifest = merkle.build(docs)
    found = merkle.log(manifest).collect()
    for key in ("=a", "=b"):
        nodes = sorted((r["place"], r["level"], r["index"], r["digest"]) for r in found if r["key"] == key)
        assert [n[0] for n in nodes] == list(range(len(nodes)))
        by_place = {(level, index): (place, digest) for place, level, index, digest in nodes}
        for (level, index), (place, digest) in by_place.items():
            if level:
                children = [by_place[level - 1, i] for i in range(16 * index, 16 * index + 16) if (level - 1, i) in by_place]
                assert max(p for p, _ in children) == place - 1
                assert sha("".join(d for _, d in children)) == digest


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 256, 257, 300, 4097])
def test_places_agree_with_the_log(leaves):
    values = [i.to_bytes(32, "big") for i in range(leaves)]
    log = merkle.postorder(values, None)
    assert [log[merkle.place(0, i, leaves)] for i in range(leaves)] == values
    levels = plain_tree([v.hex() for v in values])
    for level, nodes in enumerate(levels):
        assert [log[merkle.place(level, i, leaves)].hex() for i in range(len(nodes))] == nodes


# --- SimHash -----------------------------------------------------------------------

def plain_print(text, size=3):
    words = [w for w in re.split("[\x20\x09-\x0D]+", lowered(text or "")) if w]
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    values = sorted({p for _, p in prints})
    parent = {p: p for p in values}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(values):
        for b in values[k + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted(((i, f"{p:016x}", least.get(root(p))) for i, p in prints), key=str)


def test_simhash_on_the_table(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    found = all_queries()["op13_simhash"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == plain_groups(map(tuple, docs.collect()))


def test_simhash_odd_rows(spark):
    rows = [(1, "One two  three\tfour", None), (2, "one two three four", None), (3, None, "a"), (4, "", "a"), (5, " \n", "a"),
            (6, "two words", None), (6, "TWO words", None), (None, "lonely words here", None), (7, "É é   É", None),
            (8, "a a a " * 5000, None), (9, "A A A " * 4000, None)]
    found = covering.near_groups(odd_table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == plain_groups([r[:2] for r in rows])
    assert covering.near_groups(odd_table(spark, [])).collect() == []


def test_fingerprint_of_slices(monkeypatch):
    text = " ".join(random.Random(1).choices(["Alpha", "b", "gamma", "é" * 30], k=400))
    monkeypatch.setattr(covering, "SLICE", 13)
    assert covering.fingerprint(text) == plain_print(text)


def test_masks_leave_out_any_three_positions():
    rng = random.Random(2)
    for free in [(1 << 64) - 1, 0xFFFF0000FF, 0b1011, rng.getrandbits(64) & rng.getrandbits(64)]:
        bits = [b for b in range(64) if free >> b & 1]
        tables = covering.masks(free)
        assert len(tables) == 15 and all(t & ~free == 0 for t in tables)
        for _ in range(500):
            chosen = sum(1 << b for b in rng.sample(bits, 3))
            assert any(t & chosen == 0 for t in tables)


@pytest.mark.parametrize("bucket", [2048, 20, 2])
def test_links_in_crowded_buckets(spark, bucket):
    """Fingerprints that agree in most bits: every bucket is large and goes through all rounds."""
    rng = random.Random(bucket)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 1, 2, 5, 9]))) & (1 << 64) - 1 for _ in range(250)}
    values |= {base ^ v for v in range(120)} | {rng.getrandbits(64) for _ in range(200)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    links = covering.print_links(spark.createDataFrame([(v,) for v in signed], "_print bigint").repartition(3), bucket=bucket)
    parent = {v: v for v in values}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in links.collect():
        parent[root(r["_a"] & (1 << 64) - 1)] = root(r["_b"] & (1 << 64) - 1)
    found = {v: root(v) for v in values}
    parent = {v: v for v in values}
    ordered = sorted(values)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    same = defaultdict(set)
    for v in values:
        same[found[v]].add(root(v))
    assert all(len(s) == 1 for s in same.values()) and len(same) == len({root(v) for v in values})
