import numpy as np
import pytest
from pyspark.sql import functions as F

from plainread.functions import wordlists as W
from plainread.operators import annotate, embedding, frequency, segment, syntax
from plainread.operators.lookup import lookup
from plainread.plans import model, profile, scores
from plainread.session import materialize
from plainread.sources import entities, lexicons, pages, training, weights
from tests.conftest import SF


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_sentences_drop_blanks_and_renumber(spark):
    rows = segment.sentences(docs_of(spark, "One.  \n \n Two! three", "", " . ")).collect()
    assert [(r.doc_id, r.sent_id, r.text) for r in rows] == [
        (0, 0, "One."), (0, 1, "Two!"), (0, 2, "three"), (2, 0, ".")]


def test_dot_segments(spark):
    kept = segment.dot_segments(docs_of(spark, "A b. c."), keep_blank=True).collect()
    assert [r.sentence for r in kept] == ["A b", " c", ""]
    assert segment.dot_segments(docs_of(spark, "A b. c.")).count() == 2


def table_of(spark, text):
    return annotate.token_table(docs_of(spark, text)).orderBy("sent_id", "tok_idx").collect()


def test_annotation_rules(spark):
    rows = table_of(spark, "The old dogs were chased quickly by Anna.")
    assert [r.pos for r in rows] == ["DET", "NOUN", "NOUN", "AUX", "VERB", "ADV", "ADP", "PROPN",
                                     "PUNCT"]
    assert [r.dep for r in rows] == ["det", "dep", "nsubjpass", "auxpass", "ROOT", "advmod", "prep",
                                     "dobj", "punct"]
    assert [r.head_idx for r in rows] == [1, 4, 4, 4, None, 4, 7, 4, 4]
    assert [r.lemma for r in rows][2:5] == ["dog", "be", "chas"]
    perfect = table_of(spark, "She has walked and is walking.")
    assert [r.aspect for r in perfect if r.pos == "VERB"] == ["Perf", "Prog"]


def test_depth_of_a_chain_needs_doubling(spark):
    n = 1000
    rows = spark.createDataFrame([([None, *range(n - 1)],), ([None, 0, 0, 0],), ([None],)],
                                 "head array<int>")
    depth = [r[0] for r in rows.select(syntax.dependency_depth(F.col("head"))).collect()]
    assert depth == [n - 1, 1, 0]


def test_one_very_long_sentence(spark):
    rows = table_of(spark, "the big word " * 3000)
    assert len(rows) == 9000
    assert rows[8997].head_idx == 8998


def test_token_table_route_gives_the_same_features(spark):
    texts = documents(spark)
    direct = profile.sentence_features(texts, semantic=False).filter("sent_id is not null")
    table = materialize(annotate.token_table(texts))
    routed = profile.sentence_features_of_tokens(table, segment.sentences(texts))
    names = [*W.FEATURES, "negations"]
    both = direct.join(routed.select("doc_id", "sent_id", *[F.col(n).alias(f"_{n}") for n in names]),
                       ["doc_id", "sent_id"], "full")
    differ = both.filter(F.greatest(*[F.coalesce(F.abs(F.col(n) - F.col(f"_{n}")), F.lit(9.0))
                                      for n in names]) > 1e-9)
    assert direct.count() == both.count() > 0
    assert differ.count() == 0


@pytest.mark.parametrize("rank", ["n", None])
def test_lookup_beyond_the_broadcast_limit_is_the_same(spark, rank, monkeypatch):
    texts = documents(spark)
    table = materialize(frequency.word_zipf(frequency.corpus_words(texts))
                        .filter(F.length("word") % 2 == 0))
    tokens = annotate.word_tokens(texts).select("doc_id", "sent_id", "lower")
    monkeypatch.setattr("plainread.operators.lookup.HEAD_ROWS", 50)
    small = lookup(tokens, table, "lower", "word", ["zipf"], ["doc_id", "sent_id"], rank)
    large = lookup(tokens, table, "lower", "word", ["zipf"], ["doc_id", "sent_id"], rank, limit=0)
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def brute(vectors):
    out = []
    for i, v in enumerate(vectors):
        sims = [0.0 if not (np.linalg.norm(v) and np.linalg.norm(u)) else
                float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)) for u in vectors[:i]]
        out.append((sims[-1], np.mean(sims), max(sims)) if sims else (0.0, 0.0, None))
    return out


@pytest.mark.parametrize("stripe", [7, 1000])
def test_previous_similarity_over_stripes(spark, stripe):
    rng = np.random.default_rng(0)
    rows, expected = [], {}
    for group, n in (("hot", 60), ("cold", 5), ("one", 1)):
        vectors = rng.normal(size=(n, 6))
        vectors[n // 2] = 0
        at = np.sort(rng.choice(200, n, replace=False))
        rows += [(group, int(a), v.tolist()) for a, v in zip(at, vectors)]
        expected.update({(group, int(a)): e for a, e in zip(at, brute(vectors))})
    table = spark.createDataFrame(rows, "g string, at long, v array<double>")
    got = embedding.previous_similarity(table, ["g"], "at", "v", stripe).collect()
    assert len(got) == len(expected)
    near = {(r["g"], r["at"]): r["adjacent"] for r in embedding.adjacent_cosine(
        table, ["g"], "at", "v", block=stripe).collect()}
    for r in got:
        adjacent, mean, top = expected[r["g"], r["at"]]
        assert r["adjacent"] == pytest.approx(adjacent)
        assert near[r["g"], r["at"]] == pytest.approx(adjacent)
        assert r["mean_previous"] == pytest.approx(mean)
        assert r["max_previous"] == (None if top is None else pytest.approx(top))


def test_document_kernel_over_blocks(monkeypatch):
    from plainread.functions import kernels
    monkeypatch.setattr(kernels, "BLOCK", 4)
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 5, 19)
    buckets = rng.integers(0, 8, sizes.sum())
    parts = np.split(buckets, np.cumsum(sizes)[:-1])
    vectors = [np.bincount(p.astype(int), minlength=8).astype(float) for p in parts]
    got = kernels.one_document(buckets, sizes, 8, None)
    for g, (adjacent, mean, top) in zip(got, brute(vectors)):
        assert g == pytest.approx((adjacent, mean, 0.0 if top is None else top))


def test_edge_documents_keep_a_profile_row(spark):
    texts = docs_of(spark, "", "   ", "?!?", "Cats.", "No verb here", None)
    rows = profile.profile_flat(profile.sentence_features(texts)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(6))
    assert rows[0].word_count_max == 0 and rows[3].word_count_avg == 2
    assert rows[3].lsa_given_new_avg == 0


def test_profile_properties(spark):
    features = profile.sentence_features(documents(spark))
    flat = profile.profile_flat(features)
    order = " or ".join(f"{f}_min > {f}_avg + 1e-9 or {f}_avg > {f}_max + 1e-9" for f in W.FEATURES)
    assert flat.filter(order).count() == 0
    assert flat.count() == documents(spark).count()
    ratios = [f for f in W.FEATURES if "overlap" in f or "repetition" in f or "diversity" in f]
    outside = " or ".join(f"{f} < -1e-9 or {f} > 1 + 1e-9" for f in ratios)
    assert features.filter(outside).count() == 0
    assert set(profile.nested(features).columns) >= {"surface", "syntax", "lexical", "cohesion"}


def test_profile_plan(spark):
    zipf = materialize(frequency.word_zipf(frequency.corpus_words(documents(spark))))
    norms = materialize(zipf.select("word", *[F.length("word").cast("double").alias(n) for n in (
        "aoa", "concreteness", "familiarity", "imagery")]))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = profile.profile_flat(profile.sentence_features(texts, zipf=zipf, norms=norms))
    whole.collect()
    final = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line and "doc_id" in line]
    assert len(scans) == 1 and final.count("EvalPython") == 1
    assert final.count("Exchange hashpartitioning") == 1
    flat = profile.profile_flat(profile.sentence_features(documents(spark), semantic=False))
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("doc_id" in line and "sent_id" not in line for line in keys) and len(keys) <= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_training_file(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        '"ID "," Excerpt","BT\n Easiness",SMOG Readability,firstPlace_pred,Kaggle split\n'
        'a,"line one\nline ""two"", end",-1.5,8,,Train\n'
        'b,text,,7,1,Test\n,text,1,7,1,Test\nc,,1,7,1,Test\nd,text,bad,7,1,Test\n'
        'e,more text,2,oops,0.5,Test\n', encoding="utf-8")
    rows = training.read_training(spark, str(tmp_path / "train.csv")).collect()
    assert [r.id for r in rows] == ["a", "e"]
    assert rows[0].excerpt == 'line one\nline "two", end'
    assert (rows[0].smog, rows[0].kaggle_predictions.first, rows[1].smog) == (8.0, None, None)
    assert rows[1].kaggle_predictions.first == 0.5 and rows[1].ari is None
    assert [r.id for r in training.read_training(spark, str(tmp_path / "train.csv"), 1).collect()] == ["a"]


def test_norms_last_complete_row_wins(spark, tmp_path):
    (tmp_path / "norms.csv").write_text(
        "Word,Age of Acquisition Rating,Concreteness,Familiarity,Imageability\n"
        " CAT ,1,2,3,4\ncat,5,6,7,8\ncat,NA,9,9,9\ndog,NA,1,1,1\n")
    rows = lexicons.read_norms(spark, str(tmp_path / "norms.csv")).collect()
    assert [tuple(r) for r in rows] == [("cat", 5.0, 6.0, 7.0, 8.0)]


def test_weights_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    weights.save_weights(spark, weights.SAVED, path)
    assert weights.load_weights(spark, path) == weights.SAVED
    with pytest.raises(Exception):
        weights.save_weights(spark, weights.SAVED, path)
    assert weights.read_weights_table(spark, path).count() == len(W.FEATURES) == 48


def test_entities_and_pages(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{\n "hospitals": [\n {"name": "A", "state": "CA", "type": "X", "rank": 1}\n ]\n}')
    assert [tuple(r) for r in entities.read_entities(spark, str(tmp_path / "e.json")).collect()] == [
        ("A", "CA", "X", 1)]
    links = spark.createDataFrame([("a", "x.html", 1), ("a", "y.pdf", 2), ("a", "z.pdf", 3),
                                   ("b", "1", 1), ("b", "2", 2), ("b", "3", 3), ("b", "4.pdf", 4), ("c", "5.html", 1)],
                                  "entity string, link string, rank int")
    best = entities.first_matching_link(links)
    assert {r.entity: r.link for r in best.collect()} == {
        "a": "y.pdf", "b": "4.pdf", "c": None}
    failed = entities.failed_extractions(links.select("entity").distinct(), best, ["entity"], "link")
    assert [r.entity for r in failed.collect()] == ["c"]
    html = spark.createDataFrame([("<p>Hi <b>you</b></p><script>x</script>",), ("<p> </p>",)], "h string")
    assert [r[0] for r in html.select(pages.page_text(F.col("h"))).collect()] == ["Hi you", None]
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, " a"), (1, 3, ""), (2, 1, None)],
                                  "d int, n int, t string")
    assert {r.d: r.t for r in pages.concat_pages(parts, ["d"], "n", "t").collect()} == {1: "a\nb", 2: ""}


def test_ruleset_as_input_of_the_features(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"first_person": ["they"],\n "connectives": '
                                     '{"causal_connectives": ["And", "due to"], "logical_connectives": ["and"]}}')
    ruleset = lexicons.read_ruleset(spark, str(tmp_path / "r.json"))
    listed = {r.word: r.rule_categories for r in lexicons.ruleset_words(ruleset).collect()}
    assert listed == {"they": ["first_person"], "and": ["causal", "logical"]}
    texts = docs_of(spark, "They sat and I ran.")
    own = profile.sentence_features(texts, semantic=False, ruleset=ruleset).first()
    built_in = profile.sentence_features(texts, semantic=False).first()
    assert (own.causal_connectives, own.logical_connectives, own.additive_connectives) == (1, 1, 0)
    assert (own.first_person_pronouns, built_in.first_person_pronouns) == (1, 1)
    assert own.connectives_total == 2


def test_a_lookup_table_with_a_repeated_key_is_refused(spark):
    tokens = spark.createDataFrame([(1, 0, "a")], "doc_id int, sent_id int, lower string")
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "word string, zipf double")
    with pytest.raises(ValueError):
        lookup(tokens, table, "lower", "word", ["zipf"], ["doc_id", "sent_id"])


def test_order_values_do_not_matter(spark):
    """Sparse, negative and time-like orders give what dense ones give, in as many tiles."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 4)).tolist()
    results = []
    for at in (range(40), range(-2_000_000, 2_000_000, 100_000), range(1_700_000_000_000, 1_700_000_000_040)):
        table = spark.createDataFrame([("g", a, v) for a, v in zip(at, vectors)], "g string, at long, v array<double>")
        rows = embedding.previous_similarity(table, ["g"], "at", "v", 9).orderBy("at").collect()
        near = embedding.adjacent_cosine(table, ["g"], "at", "v", 9).orderBy("at").collect()
        results.append([(r.adjacent, r.mean_previous, r.max_previous, n.adjacent) for r, n in zip(rows, near)])
    assert len(results[0]) == 40 and results[0] == results[1] == results[2]


def test_cells_and_dense_embeddings_agree(spark):
    sentences = segment.sentences(docs_of(spark, "The cat sat. The dog ran and ran.", "123!"))
    dense = {(r.doc_id, r.sent_id): r.embedding for r in embedding.hashed_embedding(sentences).collect()}
    assert len(dense) == sentences.count()
    cells = {}
    for r in embedding.hashed_cells(sentences).collect():
        cells.setdefault((r.doc_id, r.sent_id), {})[r.cell] = r.value
    assert {k: {i: v for i, v in enumerate(e) if v} for k, e in dense.items() if any(e)} == cells


def test_classic_scores(spark):
    row = scores.readability(docs_of(spark, "The cat sat. It ran beautifully.")).first()
    words, sents, syllables, hard = 6, 2, 9, 1
    assert row.flesch_ease == pytest.approx(206.835 - 1.015 * words / sents - 84.6 * syllables / words)
    assert row.smog == pytest.approx(1.043 * (30 * hard / sents) ** 0.5 + 3.1291)


def test_training_and_attributions(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(120, 48))
    target = values @ np.arange(48) * 0.1 + 3
    rows = [(i, *map(float, v)) for i, v in enumerate(values)]
    means = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in W.FEATURES))
    labels = spark.createDataFrame([(i, float(t)) for i, t in enumerate(target)],
                                   "doc_id long, label double")
    pairs = model.training_pairs(means, labels)
    fitted = model.linear_weights(model.train(pairs, model.linear_regressor()))
    assert np.allclose(fitted.coefficients, np.arange(48) * 0.1, atol=1e-3)
    got = model.attributions(means, fitted).orderBy("doc_id").first()
    centred = np.array(fitted.coefficients) * (values[0] - values.mean(axis=0))
    assert np.allclose([got[f] for f in W.FEATURES], centred)
    assert model.global_importance(model.attributions(means, fitted)).count() == 48


def test_sentence_scores_equal_scoring_each_piece(spark):
    texts = docs_of(spark, "The cat sat. Dogs barked because cats ran! They slept.")
    got = {r.sentence: r.score for r in model.sentence_scores(texts).collect()}
    pieces = docs_of(spark, *got)
    alone = model.score(profile.profile_means(profile.sentence_features(pieces, compat=True)))
    assert {p: s for p, s in zip(got, [r.score for r in alone.orderBy("doc_id").collect()])} == \
        pytest.approx(got)
