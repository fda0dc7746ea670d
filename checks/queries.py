"""The registered queries: each operator over the whole given tables.

Doubles are rounded to six decimals, as the SQL they are compared with.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainread.functions import wordlists as W
from plainread.operators import annotate, chart, cohesion, document, embedding, frequency, latent, lexical
from plainread.operators import phrases, segment, surface, syntax
from plainread.plans import attribution, model, profile, scores
from plainread.session import materialize, new_path
from plainread.sources import entities, lexicons, pages, training, weights
from plainread.sources.tables import read_table, spread

ROW = ["doc_id", "sent_id"]
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
_fitted: dict[tuple[str, str, str], DataFrame] = {}


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def nudged(*names: str) -> list[Column]:
    """As r6, but off exact halves: the engines round halves of inexact decimals (sums of
    two-decimal frequencies over a count) differently."""
    return [F.round(F.col(n).cast("double") + 1e-9, 6).alias(n) for n in names]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"))


def once(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table fitted once per session and folder, kept as a written table."""
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, make.__name__)
        if key not in _fitted:
            _fitted[key] = materialize(make(spark, sf), make.__name__)
        return _fitted[key]

    return get


@once
def zipf(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.word_zipf(frequency.corpus_words(docs(spark, sf)))


def norms_file(spark: SparkSession, sf: str) -> str:
    """A norms CSV derived from the corpus vocabulary: untidy words, NA cells, repeated
    words whose later row differs, and zero ratings."""
    words = zipf(spark, sf).filter(F.col("word").rlike(r"^\p{L}+$")).select(
        F.col("word").alias("form"))
    size = F.length("form")
    first = words.select(F.lit(1).alias("part"), "form", F.concat(
        F.lit(" "), F.translate("form", ASCII_LOWER, ASCII_LOWER.upper()), F.lit(" "))
        .alias(W.NORMS_WORD), size.alias("size"))
    again = words.filter(size % 2 == 0).select(
        F.lit(2).alias("part"), "form", F.col("form").alias(W.NORMS_WORD),
        (size + 100).alias("size"))
    rows = first.union(again).orderBy("part", "form")
    path = new_path(spark, "norms")
    rows.select(
        W.NORMS_WORD,
        F.when(F.col("size") % 7 != 0, F.col("size") * 10).alias(W.NORMS_COLUMNS["aoa"]),
        (F.col("size") * 3 + 200).alias(W.NORMS_COLUMNS["concreteness"]),
        F.when(F.col("size") % 3 == 0, 0).otherwise(F.col("size") + 300)
        .alias(W.NORMS_COLUMNS["familiarity"]),
        (F.col("size") * F.col("size")).alias(W.NORMS_COLUMNS["imagery"]),
    ).write.option("header", True).option("nullValue", "NA").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@once
def norms(spark: SparkSession, sf: str) -> DataFrame:
    return lexicons.read_norms(spark, norms_file(spark, sf))


# --- sources --------------------------------------------------------------------

_files: dict[tuple[str, str], str] = {}


def training_file(spark: SparkSession, sf: str) -> str:
    """The training file of a folder, written once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _files:
        _files[key] = write_training_file(spark, sf)
    return _files[key]


def write_training_file(spark: SparkSession, sf: str) -> str:
    """``documents`` with ``labels`` as a training CSV with an untidy header, text
    over several lines, blank and malformed numbers; files in doc_id order."""
    table = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "n/a").otherwise(F.col("quality").cast("string"))
    score = F.when(F.col("quality") == 1, F.col("n_chars").cast("string"))
    rival = F.when(F.col("toxic") == 0, (F.col("n_chars") / 4).cast("string")).otherwise("?")
    path = new_path(spark, "training")
    table.orderBy("doc_id").select(
        F.col("doc_id").cast("string").alias(" ID"), F.col("text").alias("Excerpt "),
        label.alias("BT Easiness"), score.alias(W.TRAIN_SCORES["flesch_reading_ease"]),
        rival.alias(W.TRAIN_SCORES["smog"]), score.alias(W.TRAIN_RIVALS["first"]),
        rival.alias(W.TRAIN_RIVALS["sixth"]), F.col("lang").alias(W.TRAIN_SPLIT),
    ).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def train_read(spark: SparkSession, sf: str) -> DataFrame:
    raw = training.read_training_raw(spark, training_file(spark, sf))
    return raw.select(F.col("ID").cast("bigint").alias("id"), F.col("Excerpt").alias("excerpt"),
                      F.col(W.TRAIN_LABEL).alias("label"), F.col(W.TRAIN_SPLIT).alias("split"))


def train_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.read_training(spark, training_file(spark, sf))
    return rows.select(F.col("id").cast("bigint").alias("id"), "excerpt", *r6("bt_easiness"))


def train_optional_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.read_training(spark, training_file(spark, sf))
    rows = rows.withColumn("first", F.col("kaggle_predictions.first")).withColumn(
        "sixth", F.col("kaggle_predictions.sixth"))
    return rows.select(F.col("id").cast("bigint").alias("id"), *r6(
        "flesch_reading_ease", "smog", "ari", "first", "sixth"))


def train_first_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.read_training(spark, training_file(spark, sf), 100)
    return rows.select(F.col("id").cast("bigint").alias("id"), *r6("bt_easiness"))


def lexicon_norms(spark: SparkSession, sf: str) -> DataFrame:
    return norms(spark, sf).select("word", *r6(*W.NORMS_COLUMNS))


def ruleset_file(spark: SparkSession) -> str:
    path = new_path(spark, "ruleset")
    text = json.dumps({"first_person": W.FIRST_PERSON, "connectives": {
        f"{name}_connectives": words for name, words in W.CONNECTIVES.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def ruleset_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of the rule set with their number of occurrences as single tokens."""
    rules = lexicons.read_ruleset(spark, ruleset_file(spark))
    return rules.join(zipf(spark, sf), rules["phrase"] == F.col("word"), "left").select(
        "category", "phrase", F.coalesce("n", F.lit(0)).alias("n"))


RULES = {"first_person": ["you", "it", "they"], **{
    name: W.CONNECTIVES[other] for name, other in zip(W.CONNECTIVES, [*list(W.CONNECTIVES)[1:], list(W.CONNECTIVES)[0]])}}


#: A category that no built-in list has.
OWN_PHRASES = ["of the", "in ... and", "a  lot", "e.g. this"]


def ruleset_features(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by a rule-set file other than the built-in lists: each category has the words and phrases
    of the next, other pronouns are first person, and there is a category more."""
    path = new_path(spark, "ruleset")
    text = json.dumps({"first_person": RULES["first_person"], "connectives": {
        **{f"{name}_connectives": RULES[name] for name in W.CONNECTIVES}, "own_connectives": OWN_PHRASES}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rules = lexicons.read_ruleset(spark, path)
    rows = profile.sentence_features(docs(spark, sf), semantic=False, ruleset=rules)
    held = phrases.phrase_columns(segment.sentences(docs(spark, sf)), rules, [*W.CONNECTIVES, "own"])
    return rows.filter(F.col("sent_id").isNotNull()).join(held, ROW).select(
        *ROW, *[f"{name}_connectives" for name in W.CONNECTIVES], "first_person_pronouns",
        *[f"{name}_phrases" for name in [*W.CONNECTIVES, "own"]])


def entities_read(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as entity files, 100 to an object, read back."""
    rows = (read_table(spark, sf, "supplier")
            .join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    one = F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("state"),
                   F.col("r_name").alias("type"), F.col("s_suppkey").alias("rank"))
    path = new_path(spark, "entities")
    (rows.groupBy(F.floor(F.col("s_suppkey") / 100).alias("batch"))
     .agg(F.collect_list(one).alias("hospitals")).select("hospitals").write.json(path))
    return entities.read_entities(spark, path, multi_line=False)


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, link, rank): the host of each page, its address, its number."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return read_table(spark, sf, "pages").select(
        host.alias("entity"), F.col("url").alias("link"), F.col("page_id").alias("rank"))


def first_matching_link(spark: SparkSession, sf: str) -> DataFrame:
    return entities.first_matching_link(page_links(spark, sf), suffix="/")


def failed_extractions(spark: SparkSession, sf: str) -> DataFrame:
    links = page_links(spark, sf)
    found = entities.first_matching_link(links, suffix="/")
    return entities.failed_extractions(links.select("entity").distinct(), found, ["entity"], "link")


def entity_results(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts with their first matching link, the text behind it, its classic scores and the model's."""
    found = entities.first_matching_link(page_links(spark, sf), suffix="/")
    texts = read_table(spark, sf, "pages").select("url", pages.page_text(F.col("html")).alias("text"))
    rows = scores.entity_results(found, texts, lambda chosen, keys: model.score(profile.profile_means(
        profile.sentence_features(chosen, keys, zipf=zipf(spark, sf), norms=norms(spark, sf), compat=True), keys), keys=keys))
    return rows.select("entity", "link", "text", *r6("custom", *scores.FORMULAS))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


def concat_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.concat_pages(read_table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


def weights_load(spark: SparkSession, sf: str) -> DataFrame:
    """The saved weights, written, read back, and applied to the corpus means."""
    path = new_path(spark, "weights")
    weights.save_weights(spark, weights.SAVED, path)
    corpus = compat_means(spark, sf).agg(*[F.avg(f).alias(f) for f in W.FEATURES])
    long = corpus.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).alias("corpus_mean")) for f in W.FEATURES])))
    rows = weights.read_weights_table(spark, path).join(long, "feature")
    return rows.select("idx", "feature", *r6("coefficient", "intercept", "corpus_mean"), F.round(
        F.col("coefficient") * F.col("corpus_mean"), 6).alias("contribution"))


# --- segmentation and annotation ------------------------------------------------

def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return segment.sentences(docs(spark, sf))


@once
def known_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return segment.abbreviations(docs(spark, sf))


def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return known_abbreviations(spark, sf).select("word", "n", "n_dotted", *r6("score"))


def known_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return segment.known_sentences(docs(spark, sf), known_abbreviations(spark, sf))


def dot_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segment.dot_segments(docs(spark, sf), keep_blank=True)


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return segment.tokens(docs(spark, sf))


def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.word_tokens(docs(spark, sf)).filter(F.col("tok_idx").isNotNull())


def token_pos(spark: SparkSession, sf: str) -> DataFrame:
    table = annotate.token_table(docs(spark, sf))
    return table.select(*ROW, "tok_idx", "text", "pos", "tense", "aspect")


def token_lemma(spark: SparkSession, sf: str) -> DataFrame:
    return word_rows(spark, sf).select(*ROW, "tok_idx", "lemma")


def token_dep(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.token_table(docs(spark, sf)).select(*ROW, "tok_idx", "dep", "head_idx")


def token_syllables(spark: SparkSession, sf: str) -> DataFrame:
    return word_rows(spark, sf).select(*ROW, "tok_idx", "syllables")


def token_pos_context(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of every token by the best path of a model fitted on all sentences."""
    fitted = annotate.fit_tagger(docs(spark, sf))
    return annotate.token_table(docs(spark, sf), model=fitted).select(*ROW, "tok_idx", "text", "pos")


def token_dep_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of every token by the best projective trees over scores learned from all sentences."""
    table = annotate.token_table(docs(spark, sf), columns=["tok_idx", "text", "pos", "dep", "head_idx"])
    table = materialize(chart.sentence_rows(table.filter("tok_idx is not null")), "sentences")
    rows = chart.with_heads(table, chart.fit(table))
    return rows.select(*ROW, "tok_idx", "text", "dep", "head_idx")


def syntactic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = syntax.syntactic_similarity(annotate.token_table(
        docs(spark, sf), columns=["tok_idx", "pos", "head_idx"]), clustered=True)
    return rows.select(*ROW, *r6("syntactic_similarity_prev"))


def word_zipf(spark: SparkSession, sf: str) -> DataFrame:
    return frequency.word_zipf(frequency.corpus_words(docs(spark, sf)))


def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Non-zero cells of the sentence embeddings."""
    cells = embedding.hashed_cells(segment.sentences(docs(spark, sf)))
    return cells.select(*ROW, "cell", *r6("value"))


# --- features per sentence ---------------------------------------------------------

def per_sentence(aggregates: Callable[[], dict[str, Column]], spark: SparkSession, sf: str
                 ) -> DataFrame:
    """Aggregates over the word-level token rows of each sentence."""
    made = aggregates()
    rows = word_rows(spark, sf).groupBy(*ROW).agg(*[c.alias(n) for n, c in made.items()])
    double = {n for n, t in rows.dtypes if t == "double"}
    return rows.select(*ROW, *[nudged(n)[0] if n in double else F.col(n) for n in made])


def surface_connectives(spark: SparkSession, sf: str) -> DataFrame:
    rows = per_sentence(surface.connectives, spark, sf)
    return rows.withColumn("connectives_total", surface.connectives_total())


def surface_phrases(spark: SparkSession, sf: str) -> DataFrame:
    counted = surface.phrase_counts(F.col("text"))
    return segment.sentences(docs(spark, sf)).select(*ROW, *[c.alias(n) for n, c in counted.items()])


def function_content_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = per_sentence(surface.word_kinds, spark, sf)
    return rows.withColumn("function_to_content_ratio", surface.function_content_ratio()).select(
        *ROW, *nudged("function_to_content_ratio"))


def with_lexicon(known: Callable[[], dict[str, Column]], spark: SparkSession, sf: str,
                 use: str) -> DataFrame:
    table = {"zipf": zipf, "norms": norms}[use](spark, sf)
    rows = lexical.with_lexicons(word_rows(spark, sf), ["doc_id"], **{use: table})
    made = known()
    return rows.groupBy(*ROW).agg(*[c.alias(n) for n, c in made.items()]).select(*ROW, *nudged(*made))


def features(spark: SparkSession, sf: str, *names: str, semantic: bool = False) -> DataFrame:
    """Chosen columns of the sentence features; the rest is pruned from the plan."""
    rows = profile.sentence_features(docs(spark, sf), semantic=semantic)
    rows = rows.filter(F.col("sent_id").isNotNull())
    double = {n for n, t in rows.dtypes if t == "double"}
    return rows.select(*ROW, *[F.round(n, 6).alias(n) if n in double else F.col(n) for n in names])


def feature_query(*names: str, semantic: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: features(spark, sf, *names, semantic=semantic)


def lexical_syllables(spark: SparkSession, sf: str) -> DataFrame:
    return per_sentence(lexical.mean_syllables, spark, sf)


# --- document level ------------------------------------------------------------------

def doc_lemma_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and the sorted members, joined by blanks, of the five lemma sets."""
    table = annotate.token_table(docs(spark, sf), columns=["lemma", "pos", "dep", "is_alpha"]).withColumn(
        "base", F.lower("lemma"))
    sets = document.lemma_sets(table)
    names = [c for c in sets.columns if c != "doc_id"]
    return sets.select("doc_id", *[F.array_size(n).cast("bigint").alias(f"n_{n}") for n in names],
                       *[F.array_join(n, " ").alias(n) for n in names])


def doc_lexical_diversity(spark: SparkSession, sf: str) -> DataFrame:
    rows = document.counts(word_rows(spark, sf))
    made = document.diversity()
    return rows.select("doc_id", *[c.alias(n) for n, c in made.items()]).select("doc_id", *r6(*made))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("label", "vec_id", "embedding")


def cosine_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.adjacent_cosine(embeddings(spark, sf), ["label"], "vec_id", "embedding")
    return rows.select("label", "vec_id", *r6("adjacent"))


def cosine_all_previous(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.previous_similarity(embeddings(spark, sf), ["label"], "vec_id", "embedding")
    new = F.coalesce(1.0 - F.col("max_previous"), F.lit(0.0))
    return rows.select("label", "vec_id", *r6("mean_previous"), F.round(new, 6).alias("given_new"))


def latent_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities of each sentence with earlier ones by latent vectors fitted on all sentences."""
    words = annotate.token_table(docs(spark, sf), columns=["lemma", "is_alpha"])
    cells = materialize(latent.cell_rows(words), "cells")
    table = latent.sentence_vectors(cells, together=True)
    rows = embedding.previous_similarity(table, ["doc_id"], "sent_id", "embedding", groups=cells)
    return rows.select(*ROW, *r6("adjacent", "mean_previous", "max_previous"))


# --- profile, scores, models -----------------------------------------------------------

def profile_wide(spark: SparkSession, sf: str) -> DataFrame:
    flat = profile.profile_flat(profile.sentence_features(
        docs(spark, sf), zipf=zipf(spark, sf), norms=norms(spark, sf)))
    return flat.select("doc_id", *nudged(*[c for c in flat.columns if c != "doc_id"]))


def profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    flat = profile.profile_flat(profile.sentence_features(
        docs(spark, sf), zipf=zipf(spark, sf), norms=norms(spark, sf)))
    return profile.profile_long(flat).select("doc_id", "feature", *nudged(*profile.STATS))


def profile_struct(spark: SparkSession, sf: str) -> DataFrame:
    """The profile as one record a feature, two of them laid open."""
    rows = profile.profile(profile.sentence_features(docs(spark, sf), semantic=False))
    return rows.select("doc_id", *nudged_as(
        ("nouns.avg", "nouns_avg"), ("nouns.sd", "nouns_sd"), ("word_count.min", "word_count_min"),
        ("word_count.max", "word_count_max")))


def nudged_as(*names: tuple[str, str]) -> list[Column]:
    return [F.round(F.col(a).cast("double") + 1e-9, 6).alias(b) for a, b in names]


def nested_record(spark: SparkSession, sf: str) -> DataFrame:
    """The four records of a sentence, a field of each laid open."""
    rows = profile.nested(profile.sentence_features(docs(spark, sf), semantic=False))
    return rows.filter(F.col("sent_id").isNotNull()).select(
        *ROW, F.col("surface.word_count").alias("word_count"), F.col("lexical.verbs").alias("verbs"),
        F.col("syntax.passive_constructions").alias("passive_constructions"),
        *nudged_as(("cohesion.type_token_ratio", "type_token_ratio")))


@once
def compat_means(spark: SparkSession, sf: str) -> DataFrame:
    return means(spark, sf, compat=True)


def means(spark: SparkSession, sf: str, compat: bool) -> DataFrame:
    return profile.profile_means(profile.sentence_features(
        docs(spark, sf), zipf=zipf(spark, sf), norms=norms(spark, sf), compat=compat))


def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    vectors = model.feature_vector(means(spark, sf, compat=True))
    return vectors.select("doc_id", F.posexplode("features").alias("idx", "value")).select(
        "doc_id", "idx", *nudged("value"))


@once
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Only labelled documents are featurised."""
    labels = read_table(spark, sf, "labels")
    labelled = docs(spark, sf).join(labels, "doc_id", "left_semi")
    return model.training_pairs(profile.profile_means(profile.sentence_features(
        labelled, zipf=zipf(spark, sf), norms=norms(spark, sf))), labels, label="quality")


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("doc_id", *r6("label"), *nudged(*W.FEATURES))


def fit_summary(rows: DataFrame, name: str, fitted, key: str = "doc_id") -> DataFrame:
    """What must hold of a fit whatever the solver: the mean prediction over the training rows is the
    mean label, and the training error is not above the variance of the labels."""
    both = model.score(rows, fitted, [key]).join(rows.select(key, "label"), key)
    error = F.avg((F.col("score") - F.col("label")) ** 2)
    return both.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(n) for c, n in (
        ("score", "mean_prediction"), ("label", "mean_label"))],
        (error <= F.var_pop("label") + 1e-9).alias("no_worse_than_mean")).select(
        F.lit(name).alias("model"), "*")


def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees, saved, loaded and applied."""
    path = new_path(spark, "gbt")
    model.train(pairs(spark, sf), path=path)
    return fit_summary(pairs(spark, sf), "gbt", PipelineModel.load(path))


def tree_importances(spark: SparkSession, sf: str) -> DataFrame:
    """One importance a feature, none negative, of sum 1."""
    fitted = model.train(pairs(spark, sf))
    rows = spark.createDataFrame(model.importances(fitted), "feature string, importance double")
    total = rows.agg(F.round(F.sum("importance"), 6).alias("total")).scalar()
    return rows.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("total"))


def tree_attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of boosted trees for every training row: with the base they add up to the prediction, and
    features that no tree splits on have none."""
    fitted, rows = model.train(pairs(spark, sf)), pairs(spark, sf)
    nodes = materialize(attribution.node_table(spark, fitted), "nodes")
    used = {r["feature"] for r in nodes.filter("left >= 0").select("feature").distinct().collect()}
    total = sum((F.col(f) for f in W.FEATURES), F.col("base"))
    idle = [F.col(f) for i, f in enumerate(W.FEATURES) if i not in used]
    found = attribution.tree_attributions(rows, nodes).join(model.score(rows, fitted), "doc_id")
    return found.select("doc_id", (F.abs(total - F.col("score")) < 1e-9).alias("adds_up"),
                        F.forall(F.array(F.lit(0.0), *idle), lambda x: x == 0).alias("idle_are_zero"))


def train_linear(spark: SparkSession, sf: str) -> DataFrame:
    fitted = model.linear_weights(model.train(pairs(spark, sf), model.linear_regressor()))
    return fit_summary(pairs(spark, sf), "linear", fitted)


def train_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """Training file to features, pairs, fit, saved model, and its scores."""
    rows = training.read_training(spark, training_file(spark, sf))
    features = profile.sentence_features(spread(rows.select("id", "excerpt")), ["id"], "excerpt",
                                         zipf=zipf(spark, sf), norms=norms(spark, sf))
    made = materialize(model.training_pairs(profile.profile_means(features, ["id"]), rows, "id",
                                            "bt_easiness"), "file-pairs")
    path = new_path(spark, "linear")
    model.train(made, model.linear_regressor(), path)
    return fit_summary(made, "file", PipelineModel.load(path), "id")


def score_linear(spark: SparkSession, sf: str) -> DataFrame:
    return model.score(means(spark, sf, compat=True)).select("doc_id", *r6("score"))


def sentence_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.sentence_scores(docs(spark, sf), zipf=zipf(spark, sf), norms=norms(spark, sf))
    return rows.select("doc_id", "seg_id", "sentence", *r6("score"))


def attributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.global_importance(model.attributions(compat_means(spark, sf)))
    return rows.select("feature", *r6("importance"))


def classic(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return scores.readability(docs(spark, sf)).select("doc_id", *r6(name))


def score_card(spark: SparkSession, sf: str) -> DataFrame:
    texts = docs(spark, sf)
    card = scores.score_card(model.score(means(spark, sf, compat=True)), texts)
    return card.select("doc_id", "scores.*").select("doc_id", *r6(
        "custom", "flesch_kincaid_ease", "flesch_kincaid_level", "smog_analysis", "gunning_fog"))


SENTENCE_FEATURES: dict[str, Sequence[str]] = {
    "lexical_negations": ["negations"],
    "dependency_depth": ["dependency_depth"],
    "passive_count": ["passive_constructions"],
    "words_before_root": ["words_before_main_verb"],
    "modifiers_per_np": ["modifiers_per_np"],
    "cohesion_overlaps": ["content_overlap_adjacent", "noun_overlap_adjacent",
                          "argument_overlap_adjacent"],
    "cohesion_stem_all": ["stem_overlap_all", "content_overlap_all"],
    "pos_dissimilarity": ["pos_dissimilarity_prev"],
    "word_dissimilarity": ["word_dissimilarity_prev"],
    "verb_repetition": ["verb_overlap_adjacent", "verb_tense_repetition",
                        "verb_aspect_repetition"],
    "cohesion_word_rates": ["causal_cohesion", "temporal_cohesion", "intentional_cohesion"],
    "type_token_ratio": ["type_token_ratio"],
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [train_read, train_valid_rows, train_optional_numeric, train_first_n, lexicon_norms,
             ruleset_phrases, entities_read, weights_load, page_text, first_matching_link,
             failed_extractions, concat_pages, sentences, abbreviations, known_sentences, dot_segments, tokens, token_pos,
             token_lemma, token_dep, token_syllables, token_pos_context, token_dep_chart, syntactic_similarity, latent_cohesion, word_zipf, hashed_embedding,
             surface_connectives, surface_phrases, function_content_ratio, lexical_syllables,
             doc_lemma_sets, doc_lexical_diversity, cosine_adjacent, cosine_all_previous,
             profile_wide, profile_stats, feature_vector, training_pairs, train_gbt, train_linear,
             train_from_file, tree_importances, tree_attributions, ruleset_features, entity_results, nested_record, profile_struct,
             score_linear, sentence_scores, attributions, score_card]
    out = {f.__name__: f for f in plain}
    out["surface_lengths"] = partial(per_sentence, surface.lengths)
    out["lexical_pos_counts"] = partial(per_sentence, lexical.pos_counts)
    out["lexical_person"] = partial(per_sentence, lexical.person_counts)
    out["lexical_frequency"] = partial(with_lexicon, lexical.frequency_means, use="zipf")
    out["lexical_norms"] = partial(with_lexicon, lexical.norm_means, use="norms")
    for name, columns in SENTENCE_FEATURES.items():
        out[name] = feature_query(*columns)
    out["cosine_verb_gated"] = feature_query(
        "lsa_overlap_adjacent", "lsa_overlap_all", "lsa_given_new", "lsa_verb_overlap_adjacent",
        semantic=True)
    for name in scores.FORMULAS:
        out[name] = partial(classic, name)
    return out
