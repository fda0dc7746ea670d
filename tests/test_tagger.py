"""The hidden Markov tagger against all paths of short sentences."""

import pickle
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from plainread.operators import annotate, tagger
from plainread.session import materialize
from plainread.sources.tables import read_table

from .conftest import SF

SIZE = len(tagger.TAGS)


def random_model(rng, cells=12):
    emit = rng.random((SIZE, cells))
    emit[:, 7] = 0  # a cell without counts
    return tagger.Tagger(tagger.share_of(rng.random(SIZE)), tagger.share_of(rng.random((SIZE, SIZE))), tagger.share_of(emit))


def random_sentence(rng, length, cells=12):
    masks = [int(sum(1 << t for t in rng.choice(SIZE, rng.integers(1, 4), replace=False))) for _ in range(length)]
    return [{"tok_idx": i, "cell": int(rng.integers(0, cells)), "mask": m, "tag": -1} for i, m in enumerate(masks)]


def paths(sentence):
    return product(*[[t for t in range(SIZE) if w["mask"] >> t & 1] for w in sentence])


def probability(model, sentence, path, unseen=0.0):
    out = model.start[path[0]]
    for i, t in enumerate(path):
        out *= model.follow[path[i - 1], t] if i else 1.0
        seen = model.emit[:, sentence[i]["cell"]]
        out *= seen[t] if seen.sum() else unseen
    return out


def column(sentences):
    return pa.array(sentences, pa.list_(pa.struct([(n, pa.int32()) for n in ("tok_idx", "cell", "mask", "tag")])))


def test_best_path_of_all(spark):
    rng = np.random.default_rng(1)
    model = random_model(rng)
    sentences = [random_sentence(rng, n) for n in [1, 1, 2, 3, 3, 4, 4, 5, 6, 0]]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)],
                                  "i int, words array<struct<tok_idx:int,cell:int,mask:int,tag:int>>").repartition(2)
    for r in table.select("i", tagger.tags_of(F.col("words"), model).alias("tags")).collect():
        sentence = sentences[r.i]
        best = max(paths(sentence), key=lambda p: probability(model, sentence, p, 1 / SIZE)) if sentence else ()
        assert r.tags == [tagger.TAGS[t] for t in best]


def test_expected_counts_over_all_paths():
    rng = np.random.default_rng(2)
    model = random_model(rng)
    model.emit[:, 7] = 0.1
    sentences = [random_sentence(rng, n) for n in [1, 2, 3, 3, 3, 5]]
    out = (np.zeros(SIZE), np.zeros((SIZE, SIZE)), np.zeros((SIZE, 12)))
    total = sum(tagger.expected_counts(c, a, model, out) for _, c, a, _ in tagger.blocks(column(sentences)))
    want = (np.zeros(SIZE), np.zeros((SIZE, SIZE)), np.zeros((SIZE, 12)))
    likelihood = 0.0
    for sentence in sentences:
        weights = {p: probability(model, sentence, p) for p in paths(sentence)}
        whole = sum(weights.values())
        likelihood += np.log(whole)
        for path, w in weights.items():
            want[0][path[0]] += w / whole
            for i, t in enumerate(path):
                want[2][t, sentence[i]["cell"]] += w / whole
                if i:
                    want[1][path[i - 1], t] += w / whole
    assert total == pytest.approx(likelihood)
    for a, b in zip(out, want):
        assert a == pytest.approx(b)


def test_broadcast_names_no_class_of_this_package(spark, monkeypatch):
    """A worker loads a broadcast by the names of its classes, and may not have this package."""
    seen, send = [], SparkContext.broadcast

    def broadcast(self, value):
        seen.append(pickle.dumps(value))
        return send(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    sentences = [(random_sentence(np.random.default_rng(3), 4),), ([],)]
    kind = "struct<tok_idx: int, cell: int, mask: int, tag: int>"
    rows = spark.createDataFrame(sentences, f"words array<{kind}>")
    tagger.counted(rows, None, 12)
    tagger.counted(rows, random_model(np.random.default_rng(4)), 12)
    assert len(seen) == 2 and not any(b"plainread" in s for s in seen)


def test_likelihood_never_falls(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").filter("doc_id % 4 = 0")
    model = annotate.fit_tagger(docs, cells=2048, rounds=5)
    assert len(model.likelihood) == 6
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.likelihood, model.likelihood[1:]))
    assert model.likelihood[-1] > model.likelihood[0]
    # A sentence's tags stay within what the rules allow, and the other columns follow the tags.
    rules = materialize(annotate.word_tokens(docs.repartition("doc_id")))
    tagged = materialize(annotate.word_tokens(docs.repartition("doc_id"), model=model))
    assert rules.columns == tagged.columns and rules.count() == tagged.count()
    key = ["doc_id", "sent_id", "tok_idx"]
    both = tagged.join(rules.select(*key, F.col("pos").alias("was"), F.col("text").alias("same"), "lower"
                                    ).withColumnRenamed("lower", "low"), key)
    wrong = both.filter((F.col("text") != F.col("same")) | F.col("pos").isNull()
                        | F.col("was").isin("NUM", "PUNCT") & (F.col("pos") != F.col("was")))
    assert both.count() == rules.filter("sent_id is not null").count() and wrong.count() == 0
    assert both.filter("pos <> was").count() > 0


def test_tags_follow_context(spark):
    """One form, two uses: which tag it has is told by its neighbours."""
    plain = ["The men went.", "The children saw the women.", "She went.", "They saw the men.", "We gave the children the men.",
             "The women took the children.", "They can go.", "She can see the women.", "We go.", "You see the men.",
             "The famous men went.", "A useful child took the famous men.", "They see.", "We take the useful children.", "You know."]
    texts = ["The talk went.", "She can talk.", "They saw the walk.", "We walk.", "The walk took the men.", "You talk.", *plain * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = annotate.fit_tagger(docs, cells=512, rounds=4)
    table = annotate.token_table(docs.filter("doc_id < 6"), model=model)
    tags = {(r.doc_id, r.text): r.pos for r in table.collect()}
    assert [tags[i, w] for i, w in enumerate(["talk", "talk", "walk", "walk", "walk", "talk"])] == [
        "NOUN", "VERB", "NOUN", "VERB", "NOUN", "VERB"]
    dep = {(r.doc_id, r.text): r.dep for r in table.collect()}
    assert dep[3, "walk"] == dep[5, "talk"] == "ROOT" and dep[0, "talk"] == "nsubj"
    assert {t for (_, w), t in tags.items() if w == "."} == {"PUNCT"}


def test_edge_documents(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "- ; ,"), (4, "Hm"), (None, "No id here.")], "doc_id bigint, text string")
    model = annotate.fit_tagger(docs, cells=64, rounds=2)
    rows = annotate.word_tokens(docs, model=model).collect()
    assert sorted(str(r.doc_id) for r in rows if r.tok_idx is None) == ["1", "2"]
    assert {r.pos for r in rows if r.doc_id == 3} == {"PUNCT"}
    assert len([r for r in rows if r.doc_id is None]) == 4
    empty = annotate.fit_tagger(docs.limit(0), cells=64, rounds=1)
    assert empty.emit == pytest.approx(1 / 64) and annotate.token_table(docs.limit(0), model=empty).collect() == []
