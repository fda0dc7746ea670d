"""Sentence features and document profiles.

``sentence_features`` makes one flat row per sentence with all 48 features;
``profile`` reduces it to mean, population deviation, minimum and maximum per
document.  With the built-in annotator both need one hash exchange, on the
document key: the window, the sentence aggregation after the lexicon lookups and
the document aggregation all reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W
from plainread.operators import cohesion, document, embedding, lexical, surface, syntax
from plainread.operators.annotate import gather, of_token_table, relate, word_tokens
from plainread.operators.lookup import BROADCAST_BYTES, Words
from plainread.operators.segment import sentence_array
from plainread.session import materialize
from plainread.sources.lexicons import ruleset_words
from plainread.sources.tables import by_keys, text_parts

STATS = ("avg", "sd", "min", "max")
CONSTANT_FEATURES = ["avg_polysemy"]
LEXICAL = ["nouns", "verbs", "adjectives", "adverbs", "pronouns", "first_person_pronouns",
           "third_person_pronouns", "avg_syllables_per_word", "avg_word_frequency_log",
           "avg_content_word_frequency_log", *lexical.NORM_FEATURES,
           "avg_polysemy", "negations", "causal_verbs", "intentional_actions"]
SURFACE = ["word_count", "sentence_length", "function_to_content_ratio", "connectives_total",
           "causal_connectives", "temporal_connectives", "logical_connectives",
           "additive_connectives", "adversative_connectives"]
SYNTAX = ["dependency_depth", "modifiers_per_np", "words_before_main_verb",
          "passive_constructions", "syntactic_similarity_prev"]
COHESION = W.FEATURES[W.FEATURES.index("content_overlap_adjacent"):]


def profile_tokens(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                   semantic: bool = True, idf: Sequence[float] | None = None,
                   clustered: bool = False, carry: bool = False, parts: int | None = None) -> DataFrame:
    """Token rows of ``docs``, spread by the document key, with similarities.

    The exchange moves each text once, before it grows into tokens.  Skip it with
    ``clustered`` when ``docs`` is already bucketed by the keys (and ``semantic``
    is off: a Python node hides the partitioning from the planner).
    """
    docs = docs.select(*keys, text)
    if semantic:
        docs = docs.withColumn("semantic", embedding.document_similarity(
            sentence_array(F.col(text)), idf))
    if not clustered:
        docs = by_keys(docs, keys, text, parts)
    return word_tokens(docs, keys, text, "semantic" if semantic else None, carry)


def features_of(tokens: DataFrame, keys: Sequence[str] = ("doc_id",),
                zipf: DataFrame | None = None, norms: DataFrame | None = None,
                similarity: DataFrame | None = None, compat: bool = False,
                limit: int = BROADCAST_BYTES, ruleset: DataFrame | None = None,
                words: Words | None = None) -> DataFrame:
    """(keys, sent_id, 48 features, negations) of token rows.

    ``zipf`` is (word, n, zipf) and ``norms`` is (word, aoa, concreteness, familiarity,
    imagery); both materialized, since their size decides the kind of join.
    ``similarity`` is (keys, sent_id, semantic).  What is not given counts as 0.
    ``ruleset`` (category, phrase) replaces the built-in connectives and first person.

    ``words`` are the words of the token rows, so that no large table moves them.

    Token rows that already have ``dep`` come from a caller's table; the others are
    related by rule after gathering.
    """
    keys = list(keys)
    own_labels = "dep" in tokens.columns
    rule_words = None if ruleset is None else materialize(ruleset_words(ruleset), "rule-words")
    tokens_seen = lexical.with_lexicons(document.first_uses(tokens, keys), keys, zipf, norms, limit,
                                        rule_words, words)
    person = None if ruleset is None else surface.in_category("first_person")
    connectives = surface.connectives() if ruleset is None else surface.rule_connectives()
    aggregates = {
        **lexical.pos_counts(), **lexical.person_counts(compat, person), **lexical.mean_syllables(),
        **lexical.frequency_means(zipf is not None), **lexical.norm_means(norms is not None),
        **surface.lengths(), **connectives, **surface.word_kinds(),
        **cohesion.word_rates(), **cohesion.sets(), "_alpha": F.count_if("is_alpha"),
        **{f"_{n}": c for n, c in document.sentence_counts().items()}}
    if "semantic" in tokens.columns:
        aggregates["semantic"] = F.first("semantic")
    whole_text = ["carried"] if "carried" in tokens.columns else []
    if whole_text:
        aggregates["carried"] = F.first("carried", True)
    fields = ["lemma", "base", "pos", "tense", "aspect", *(["dep", "head_idx"] if own_labels else ["flag", "label"])]
    rows = gather(tokens_seen, keys, fields, aggregates)
    if own_labels:
        rows = rows.select("*", F.col("tok.dep").alias("dep"), F.col("tok.head_idx").alias("head"),
                           F.col("tok.aspect").alias("aspect"))
    else:
        rows = relate(rows)
    if similarity is not None:
        rows = rows.join(similarity, [*keys, "sent_id"], "left")
    elif "semantic" not in rows.columns:
        rows = rows.withColumn("semantic", F.lit(None).cast(f"struct<{embedding.SIMILARITY}>"))
    own = {
        "connectives_total": surface.connectives_total(compat=compat),
        "function_to_content_ratio": surface.function_content_ratio(compat),
        "dependency_depth": syntax.dependency_depth(F.col("head")),
        "modifiers_per_np": rules.ratio(syntax.noun_modifiers(F.col("dep"), F.col("head"), compat), F.col("nouns")),
        "passive_constructions": syntax.passive_constructions(F.col("dep"), compat),
        "words_before_main_verb": syntax.root_position(F.col("dep")),
        "negations": syntax.label_count(F.col("dep"), "neg")}
    plain = [n for n in aggregates if not n.startswith("_") and n not in ("semantic", "carried")]
    rates = [n for n in plain if n in cohesion.word_rates()]
    # Sums over the document, on rows that are already together.
    document_wide = Window.partitionBy(*keys)
    counted = [F.sum(f"_{n}").over(document_wide).alias(n) for n in document.sentence_counts()]
    rows = rows.select(
        *keys, "sent_id", "semantic", "_alpha", *whole_text, *counted, *[n for n in plain if n not in rates],
        *[cohesion.later(F.col(n)).alias(n) for n in rates],
        *[c.alias(n) for n, c in own.items()], cohesion.keep().alias("here"))
    rows = cohesion.with_previous(rows, keys)
    if compat:
        # compat: the root's position counted from the start of the document
        earlier = Window.partitionBy(*keys).orderBy("sent_id").rowsBetween(
            Window.unboundedPreceding, -1)
        rows = rows.withColumn("words_before_main_verb", F.col("words_before_main_verb")
                               + F.coalesce(F.sum("word_count").over(earlier), F.lit(0)))
    pair = {**cohesion.overlaps(), **cohesion.pos_dissimilarity(), **cohesion.word_dissimilarity(),
            **cohesion.verb_repetition(), **cohesion.type_token_ratio(),
            **cohesion.semantic(F.col("semantic"))}
    rows = rows.select(*keys, "sent_id", *whole_text, *plain, *own, *document.sentence_counts(), F.struct(
        F.col("here.words").alias("words"), F.col("here.content").alias("content")).alias("here"),
        *[c.alias(n) for n, c in pair.items()])
    whole = {**cohesion.document_overlap(compat),
             **{n: cohesion.later(c) for n, c in document.diversity().items()},
             **{n: F.lit(0.0) for n in CONSTANT_FEATURES}}
    rows = rows.select(*keys, "sent_id", *whole_text, *plain, *own, *pair,
                       *[c.alias(n) for n, c in whole.items()])
    return rows.select(*keys, "sent_id", *whole_text, *W.FEATURES, "negations")


def sentence_features(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                      zipf: DataFrame | None = None, norms: DataFrame | None = None,
                      embeddings: DataFrame | None = None, compat: bool = False,
                      semantic: bool = True, idf: Sequence[float] | None = None,
                      clustered: bool = False, ruleset: DataFrame | None = None,
                      carry: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Features of every sentence of ``docs`` by the built-in annotator.

    ``embeddings`` (keys, sent_id, embedding) replaces the built-in provider.
    Documents without sentences have one row with null ``sent_id``.  ``carry`` adds the
    text of each document, on its first sentence, as ``carried``.
    """
    parts, holes = (0, True) if clustered else text_parts(docs, keys, text)
    tokens = profile_tokens(docs, keys, text, semantic and embeddings is None, idf, clustered, carry, parts)
    # Answers come to the documents by their keys, which null ones would not meet.
    words = Words(word_tokens(docs.select(*keys, text), keys, text), keys, parts) if parts and not holes else None
    return features_of(tokens, keys, zipf, norms, _similarity(embeddings, keys), compat, limit, ruleset, words)


def sentence_features_of_tokens(tokens: DataFrame, sentences: DataFrame,
                                keys: Sequence[str] = ("doc_id",), zipf: DataFrame | None = None,
                                norms: DataFrame | None = None,
                                embeddings: DataFrame | None = None,
                                compat: bool = False) -> DataFrame:
    """The same for a caller's own token table and sentence table (keys, sent_id, text)."""
    rows = of_token_table(tokens, sentences, keys).repartition(*keys)
    return features_of(rows, keys, zipf, norms, _similarity(embeddings, keys), compat)


def _similarity(embeddings: DataFrame | None, keys: Sequence[str]) -> DataFrame | None:
    if embeddings is None:
        return None
    similar = embedding.previous_similarity(embeddings, keys, "sent_id", "embedding")
    return similar.select(*keys, F.col("sent_id").cast("int").alias("sent_id"), F.struct(
        "adjacent", "mean_previous", "max_previous").alias("semantic"))


def with_syntactic_similarity(features: DataFrame, tokens: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sentence features with ``syntactic_similarity_prev`` of their token table, which is no part of the vector."""
    place = [*keys, "sent_id"]
    return features.join(syntax.syntactic_similarity(tokens, keys), place, "left").withColumn(
        "syntactic_similarity_prev", F.coalesce("syntactic_similarity_prev", F.lit(0.0)))


def nested(features: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Sentence features as four records: surface, syntax, lexical, cohesion."""
    def record(names: Sequence[str], name: str) -> Column:
        fields = [F.col(n) if n in features.columns else F.lit(0.0).alias(n) for n in names]
        return F.struct(*fields).alias(name)

    return features.select(*keys, "sent_id", record(SURFACE, "surface"),
                           record(SYNTAX, "syntax"), record(LEXICAL, "lexical"),
                           record(COHESION, "cohesion"))


def _stat(feature: str, stat: str) -> Column:
    value = F.col(feature).cast("double")
    make = {"avg": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max}[stat]
    return F.coalesce(make(value), F.lit(0.0))


def profile_flat(features: DataFrame, keys: Sequence[str] = ("doc_id",),
                 stats: Sequence[str] = STATS) -> DataFrame:
    """(keys, <feature>_<stat> ...): one hash aggregate for all features.

    Empty documents get 0 everywhere.  Unused columns are pruned by the optimizer.
    """
    varying = [f for f in W.FEATURES if f not in CONSTANT_FEATURES]
    carried = [F.first("carried", True).alias("carried")] if "carried" in features.columns else []
    out = features.groupBy(*keys).agg(*carried, *[_stat(f, s).alias(f"{f}_{s}")
                                        for f in varying for s in stats])
    constant = [F.lit(0.0).alias(f"{f}_{s}") for f in CONSTANT_FEATURES for s in stats]
    return out.select("*", *constant).select(
        *keys, *(["carried"] if carried else []), *[f"{f}_{s}" for f in W.FEATURES for s in stats])


def profile(features: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, 48 x struct<avg, sd, min, max>)."""
    flat = profile_flat(features, keys)
    return flat.select(*keys, *[F.struct(*[F.col(f"{f}_{s}").alias(s) for s in STATS]).alias(f)
                                for f in W.FEATURES])


def profile_means(features: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, 48 features): the means only, which is what models read."""
    flat = profile_flat(features, keys, ("avg",))
    carried = ["carried"] if "carried" in flat.columns else []
    return flat.select(*keys, *carried, *[F.col(f"{f}_avg").alias(f) for f in W.FEATURES])


def profile_long(flat: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, feature, avg, sd, min, max): the flat profile, one row per feature.

    Unpivoted after the aggregation, so no long table is ever shuffled.
    """
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}_{s}").alias(s)
                                                          for s in STATS]) for f in W.FEATURES])
    return flat.select(*keys, F.inline(rows))
