"""The hand-worked two-sentence document, through a caller's token table."""

import pytest

from plainread.functions import wordlists as W
from plainread.plans import profile

TOKENS = [
    # sent, tok, text, lemma, pos, dep, head, tense
    (0, 0, "The", "the", "DET", "det", 1, None), (0, 1, "cat", "cat", "NOUN", "nsubj", 2, None),
    (0, 2, "sat", "sit", "VERB", "ROOT", None, "Past"), (0, 3, ".", ".", "PUNCT", "punct", 2, None),
    (1, 0, "The", "the", "DET", "det", 1, None), (1, 1, "cat", "cat", "NOUN", "nsubj", 2, None),
    (1, 2, "ran", "run", "VERB", "ROOT", None, "Past"),
    (1, 3, "because", "because", "SCONJ", "mark", 5, None),
    (1, 4, "dogs", "dog", "NOUN", "nsubj", 5, None),
    (1, 5, "barked", "bark", "VERB", "advcl", 2, "Past"), (1, 6, ".", ".", "PUNCT", "punct", 2, None)]
SENTENCES = [(1, 0, "The cat sat."), (1, 1, "The cat ran because dogs barked.")]


def tables(spark):
    rows = [(1, s, i, text, lemma, pos, dep, head, text.isalpha(), tense, None, 1)
            for s, i, text, lemma, pos, dep, head, tense in TOKENS]
    tokens = spark.createDataFrame(
        rows, "doc_id long, sent_id int, tok_idx int, text string, lemma string, pos string, "
        "dep string, head_idx int, is_alpha boolean, tense string, aspect string, syllables int")
    return tokens, spark.createDataFrame(SENTENCES, "doc_id long, sent_id int, text string")


def features(spark, **more):
    rows = profile.sentence_features_of_tokens(*tables(spark), **more)
    return {r["sent_id"]: r for r in rows.collect()}


def test_second_sentence(spark):
    first, second = (features(spark)[i] for i in (0, 1))
    expected = {
        "sentence_length": 32, "word_count": 7, "causal_connectives": 1, "logical_connectives": 1,
        "temporal_connectives": 0, "connectives_total": 2, "nouns": 2, "verbs": 2,
        "dependency_depth": 2, "words_before_main_verb": 2, "content_overlap_adjacent": 0.5,
        "noun_overlap_adjacent": 1, "argument_overlap_adjacent": 1, "stem_overlap_all": 6 / 7,
        "pos_dissimilarity_prev": 4 / 7, "word_dissimilarity_prev": 4 / 3,
        "causal_cohesion": 1 / 7, "verb_overlap_adjacent": 0, "verb_tense_repetition": 1,
        "verb_aspect_repetition": 1, "type_token_ratio": 1, "lexical_diversity_all": 7 / 9,
        "lexical_diversity_verbs": 1}
    for name, value in expected.items():
        assert second[name] == pytest.approx(value), name
    assert (first["sentence_length"], first["word_count"], first["dependency_depth"]) == (12, 4, 2)
    for name in W.FEATURES[W.FEATURES.index("content_overlap_adjacent"):]:
        assert first[name] == 0, name


def test_compat_counts_root_from_document_start(spark):
    rows = features(spark, compat=True)
    assert rows[0]["words_before_main_verb"] == 2
    assert rows[1]["words_before_main_verb"] == 6
    assert rows[1]["connectives_total"] == 0


def test_profile(spark):
    rows = profile.sentence_features_of_tokens(*tables(spark))
    row = profile.profile(rows).first()
    assert tuple(row["nouns"]) == (1.5, 0.5, 1.0, 2.0)
    assert row["content_overlap_adjacent"]["avg"] == 0.25
    assert row["lexical_diversity_all"]["avg"] == pytest.approx(7 / 18)
    assert len(row) == 1 + len(W.FEATURES)


def test_own_norms_zero_rating_is_missing(spark):
    norms = spark.createDataFrame([("cat", 100.0, 0.0, 50.0, 10.0), ("dog", 300.0, 20.0, 0.0, 30.0)],
                                  "word string, aoa double, concreteness double, "
                                  "familiarity double, imagery double")
    second = features(spark, norms=norms)[1]
    assert second["avg_age_of_acquisition"] == 200
    assert second["avg_concreteness"] == 20
    assert second["avg_familiarity"] == 50
    assert second["avg_imagery"] == 20


def test_own_embeddings(spark):
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0])],
                                    "doc_id long, sent_id int, embedding array<double>")
    second = features(spark, embeddings=vectors)[1]
    assert second["lsa_overlap_adjacent"] == pytest.approx(0.5 ** 0.5)
    assert second["lsa_given_new"] == pytest.approx(1 - 0.5 ** 0.5)
    assert second["lsa_verb_overlap_adjacent"] == pytest.approx(0.5 ** 0.5)
