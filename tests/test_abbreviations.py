"""Sentences that know abbreviations."""

import random

from plainread.operators import segment
from plainread.session import materialize


def corpus(spark):
    rng = random.Random(5)
    words = "cat sat down it was late again we saw sea the calm they asked why nobody knew near is some said".split()
    filler = [" ".join(" ".join(rng.choices(words, k=6)).capitalize() + "." for _ in range(5)) for _ in range(200)]
    planted = [f"Then Dr. Smith met Prof. Jones at no. {i} near the etc. Some said e.g. that is it." for i in range(60)]
    return spark.createDataFrame(list(enumerate(filler + planted)), "doc_id bigint, text string").repartition(4)


def test_planted_abbreviations_are_found(spark):
    found = {r.word: r for r in segment.abbreviations(corpus(spark)).collect()}
    assert set(found) == {"dr", "prof", "no", "etc", "e.g"}
    assert found["dr"].n == found["dr"].n_dotted == 60


def test_sentences_with_them(spark):
    known = materialize(segment.abbreviations(corpus(spark)))
    texts = [(1, "Dr. Smith left. He (e.g. on foot) went to no. 5.\nProf.\nJones stayed! Why?"),
             (2, "See example.com or v1.2.3 now. End"), (3, ""), (4, None), (None, "One. Two."), (5, ". . ."), (6, "Dr."),
             (7, "a.b." * 30_000 + " Dr. x. y"), (8, "cat. Dr. Dr. sat.")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = sorted(segment.known_sentences(docs, known).collect(), key=lambda r: (str(r.doc_id), r.sent_id))
    got = {}
    for r in rows:
        assert r.sent_id == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.text)
    assert got[1] == ["Dr. Smith left.", "He (e.g. on foot) went to no. 5.", "Prof.", "Jones stayed!", "Why?"]
    assert got[2] == ["See example.com or v1.2.3 now.", "End"] and got[None] == ["One.", "Two."]
    assert got[6] == ["Dr."] and got[8] == ["cat.", "Dr. Dr. sat."]
    assert [len(t) for t in got[7]] == [120_000, 5, 1] or "".join(got[7]).replace(" ", "") == texts[7][1].replace(" ", "")
    assert set(got) == {1, 2, None, 5, 6, 7, 8}
    # Without known words only a full stop with no blank after it is kept.
    none = segment.known_sentences(docs.filter("doc_id = 1"), known.limit(0)).orderBy("sent_id").collect()
    assert [r.text for r in none] == ["Dr.", "Smith left.", "He (e.g.", "on foot) went to no.", "5.", "Prof.", "Jones stayed!", "Why?"]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert segment.abbreviations(docs).collect() == []
    assert segment.known_sentences(docs, segment.abbreviations(docs)).collect() == []
