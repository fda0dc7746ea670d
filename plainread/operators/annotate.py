"""Rule annotation: documents to token rows, token rows to sentence rows.

*Token rows* carry what a word says by itself: tag, lemma (``base`` is its lower-case
form), syllables, flags.  They are flat, so the rules run as compiled projections
around two broadcast joins with fixed tables.

*Sentence rows* gather the tokens of one sentence into one ordered array
``tok``, on which the rules that look at neighbours work (``relate``): root,
subject, object, heads.  A caller's own token table enters at ``of_token_table``
and brings those columns itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W
from plainread.operators import tagger
from plainread.operators.segment import sentence_array, token_array
from plainread.session import materialize
from plainread.sources.tables import by_keys

DEP_BY_POS = {"DET": "det", "ADP": "prep", "ADJ": "amod", "NUM": "nummod", "CCONJ": "cc",
              "SCONJ": "mark", "AUX": "aux", "ADV": "advmod", "PART": "aux", "PUNCT": "punct",
              "VERB": "advcl"}
WORD_COLUMNS = ["tok_idx", "text", "lower", "base", "lemma", "pos", "is_alpha", "syllables", "tense",
                "aspect", "flag", "label"]
TABLE_COLUMNS = ["tok_idx", "text", "lemma", "pos", "dep", "head_idx", "is_alpha", "tense",
                 "aspect", "syllables"]


def word_tokens(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                extra: str | None = None, carry: bool = False, model: tagger.Tagger | None = None) -> DataFrame:
    """(keys, sent_id, n_chars, [extra], [carried], WORD_COLUMNS): token rows of ``docs``.

    With ``model`` (``fit_tagger``) words are tagged in context, which gathers sentences once: ``docs``
    should be partitioned by the keys.

    Narrow: no shuffle.  A document without sentences keeps one row of nulls, so
    that it is not lost.  ``extra`` names an array column with one entry per
    sentence; its entry is put on every token row of the sentence.  ``carry`` puts the
    text itself on the first row of its document, as ``carried``.
    """
    keys = list(keys)
    more = [*([] if extra is None else [extra]), *(["carried"] if carry else [])]
    rows = rule_words(docs, keys, text, extra, carry)
    lower, word = F.col("lower"), F.col("text")
    if model is not None:
        rows = in_context(rows, keys, model)
    pos, verb = F.col("pos"), F.col("pos") == "VERB"
    stem = F.concat(F.left(lower, F.length(lower) - F.col("suffix_drop")), F.col("suffix_add"))
    base = F.coalesce("listed_lemma", F.when(rules.one_of(pos, ["VERB", "NOUN"]), stem), lower)
    rows = rows.select(
        *keys, "sent_id", *more, "n_chars", "tok_idx", "text", "lower", "pos",
        base.alias("base"), "listed_flag",
        (F.col("listed_flag").isNotNull() | ~rules.one_of(pos, ["PUNCT", "NUM"])).alias("is_alpha"),
        (verb & rules.one_of(F.col("_suffix"), ["ed", "ied"])).alias("_ed"),
        (verb & (F.col("_suffix") == "ing")).alias("_ing"),
        (verb & F.coalesce("is_past", F.lit(False))).alias("_past"),
        (verb & lower.endswith(F.lit("en"))).alias("_en"))

    def bit(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    ed, ing = F.col("_ed"), F.col("_ing")
    labels = F.create_map(*[F.lit(x) for pair in DEP_BY_POS.items() for x in pair])
    return rows.select(
        *keys, "sent_id", *more, "n_chars", "tok_idx", "text", "lower", "base",
        F.when(pos == "PROPN", word).otherwise(F.col("base")).alias("lemma"), "pos", "is_alpha",
        rules.syllables(lower, F.col("is_alpha")).alias("syllables"),
        F.when(ed | F.col("_past"), "Past").when(ing, "Pres").alias("tense"),
        F.when(ing, "Prog").alias("aspect"),
        (F.coalesce("listed_flag", F.lit(0)) + bit(ed | F.col("_en"), rules.PARTICIPLE)
         + bit(rules.one_of(pos, rules.NOMINAL_POS), rules.NOMINAL)
         + bit(rules.one_of(pos, rules.FORWARD_POS), rules.FORWARD)
         + bit(ed, rules.ED)).alias("flag"),
        F.coalesce(F.try_element_at(labels, pos), F.lit("dep")).alias("label"))


def rule_words(docs: DataFrame, keys: Sequence[str], text: str = "text", extra: str | None = None,
               carry: bool = False) -> DataFrame:
    """Word rows with the tag the rules give and what the tables list for the word."""
    keys = list(keys)
    more = [*([] if extra is None else [extra]), *(["carried"] if carry else [])]
    docs = docs.select(*docs.columns, F.col(text).alias("carried")) if carry else docs
    whole = ["carried"] if carry else []
    if extra is None:
        rows = docs.select(*keys, *whole, F.posexplode_outer(sentence_array(F.col(text))).alias(
            "sent_id", "sentence"))
    else:
        both = F.arrays_zip(sentence_array(F.col(text)).alias("sentence"), F.col(extra))
        rows = docs.select(*keys, *whole, F.posexplode_outer(both).alias("sent_id", "s"))
        rows = rows.select(*keys, *whole, "sent_id", F.col("s.sentence").alias("sentence"),
                           F.col(f"s.{extra}").alias(extra))
    rows = rows.select(
        *keys, "sent_id", *more, F.length("sentence").alias("n_chars"),
        F.posexplode_outer(token_array(F.col("sentence"))).alias("tok_idx", "text"))
    if carry:
        opens = (F.coalesce("sent_id", F.lit(0)) == 0) & (F.coalesce("tok_idx", F.lit(0)) == 0)
        rows = rows.withColumn("carried", F.when(opens, F.col("carried")))
    word, lower = F.col("text"), F.col("lower")
    rows = rows.withColumn("lower", F.lower("text"))
    rows = rows.withColumn("_suffix", rules.suffix_of(lower))
    spark = docs.sparkSession
    listed, suffixes = rules.listed_word_table(spark), rules.suffix_table(spark)
    rows = rows.join(F.broadcast(listed), rows["lower"] == listed["form"], "left")
    applies = (rows["_suffix"] == suffixes["suffix"]) & (
        F.length(rows["lower"]) >= suffixes["shortest"])
    rows = rows.join(F.broadcast(suffixes), applies, "left")
    open_tag = (F.when(word.rlike(r"^\p{L}"), F.coalesce(F.when(
                    (F.col("tok_idx") > 0) & (word != lower)
                    & (F.coalesce("suffix_tag", F.lit("NOUN")) == "NOUN"), "PROPN"),
                    "suffix_tag", F.lit("NOUN")))
                .when(word.rlike(r"^\p{N}"), "NUM").when(word.isNotNull(), "PUNCT"))
    return rows.select(
        *keys, "sent_id", *more, "n_chars", "tok_idx", "text", "lower", "_suffix", "listed_tag",
        "listed_lemma", "listed_flag", "is_past", "suffix_drop", "suffix_add",
        F.coalesce("listed_tag", open_tag).alias("pos"))


def in_context(rows: DataFrame, keys: Sequence[str], model: tagger.Tagger) -> DataFrame:
    """Rule-tagged word rows with the tags of each sentence's best path; all else as it was."""
    place = [*keys, "sent_id"]
    others = [c for c in rows.columns if c not in place]
    listed = F.col("_all.listed_tag").isNotNull()
    packed = rows.select(*place, F.struct("tok_idx", *[c for c in others if c != "tok_idx"]).alias("_all"))
    cell = rules.hash_bucket(F.col("_all.lower"), model.emit.shape[1])
    word = F.when(F.col("_all.tok_idx").isNotNull(), F.struct(
        cell.alias("cell"), tagger.choices(F.col("_all.pos"), F.col("_all.lower"), listed).alias("mask"),
        F.lit(-1).alias("tag")))
    held = packed.select(*place, F.struct("_all", word.alias("word")).alias("_one")).groupBy(*place).agg(
        F.sort_array(F.collect_list("_one")).alias("_ones"))
    words = F.filter("_ones.word", lambda w: w.isNotNull())
    tagged = held.select(*place, "_ones", tagger.tags_of(words, model).alias("_tags"))
    one = tagged.select(*place, F.posexplode("_ones._all").alias("_i", "_all"), "_tags")
    return one.select(*place, *[(F.get("_tags", F.col("_i")) if c == "pos" else F.col(f"_all.{c}")).alias(c) for c in others])


def fit_tagger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", cells: int = tagger.CELLS,
               rounds: int = tagger.ROUNDS) -> tagger.Tagger:
    """A model of tags in context, learned from all sentences of ``docs``."""
    words = rule_words(by_keys(docs.select(*keys, text), keys, text), keys, text)
    rows = materialize(tagger.sentence_words(words.withColumn("listed", F.col("listed_tag").isNotNull()), keys, cells), "words")
    return tagger.fit(rows, cells, rounds)


def gather(tokens: DataFrame, keys: Sequence[str], fields: Sequence[str],
           aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """Token rows to one row per sentence: ``tok``, the ordered token records, and
    any further aggregates.  Only one sentence is ever gathered."""
    record = F.when(F.col("tok_idx").isNotNull(), F.struct("tok_idx", *[
        f for f in fields if f != "tok_idx"]))
    more = [c.alias(n) for n, c in (aggregates or {}).items()]
    return tokens.groupBy(*keys, "sent_id").agg(
        F.sort_array(F.collect_list(record)).alias("tok"), *more)


def relate(rows: DataFrame) -> DataFrame:
    """Adds parallel arrays ``dep``, ``head`` and ``aspect`` to sentence rows.

    Root is the first verb, else the first token.  The nearest nominal before it
    is its subject, the first one after it its object.  A determiner, adposition,
    adjective or numeral hangs on the next nominal; all else hangs on the root.
    The next nominal of every position comes from one array built in one pass, so
    the work grows with the length of the sentence, not its square.
    """
    others = rows.columns
    flag, pos = F.col("tok.flag"), F.col("tok.pos")
    rows = rows.select(
        *others, flag.alias("_flag"),
        F.greatest(F.array_position(pos, "VERB") - 1, F.lit(0)).cast("int").alias("_root"),
        F.filter(F.transform(flag, lambda f, i: F.when(rules.has(f, rules.NOMINAL), i)),
                 lambda i: i.isNotNull()).alias("_nominal"))
    before = F.filter("_nominal", lambda p: p < F.col("_root"))
    runs = F.transform("_nominal", lambda p, k: F.array_repeat(
        p, p - F.coalesce(F.get(F.col("_nominal"), k - 1), F.lit(-1))))
    rows = rows.select(*others, "_flag", "_root", F.flatten(runs).alias("_next"),
                       F.get(before, F.array_size(before) - 1).alias("_subject"))
    # The optimizer moves an expression that is used once to its place of use, also
    # into a lambda, where it would run per token.  Hence positions are written
    # into the label array from outside, and the head lambda names each column twice.
    flag, root, following = F.col("_flag"), F.col("_root"), F.col("_next")

    def flagged(i: Column, bit: int) -> Column:
        return F.coalesce(rules.has(F.get("tok", i)["flag"], bit), F.lit(False))

    def helper(f: Column, i: Column) -> Column:
        return rules.has(f, rules.BE) & flagged(i + 1, rules.PARTICIPLE)

    passive = flagged(root - 1, rules.BE) & flagged(root, rules.PARTICIPLE)
    rows = rows.select(
        *others, "_flag", "_root", "_next", "_subject",
        F.get(following, root + 1).alias("_object"),
        F.when(passive, "nsubjpass").otherwise("nsubj").alias("_as"),
        F.transform("tok", lambda t, i: F.when(rules.has(t["flag"], rules.NEGATION), "neg")
                    .when(helper(t["flag"], i), "auxpass").otherwise(t["label"])).alias("_dep"))

    def put(name: str, at: str, value: Column) -> DataFrame:
        """Writes ``value`` at a position, unless it is null or holds neg or auxpass."""
        array, i = F.col(name), F.col(at)
        written = F.concat(F.slice(array, F.lit(1), i), F.array(value),
                           F.slice(array, i + 2, F.array_size(array)))
        taken = i.isNull() | rules.one_of(F.get(array, i), ["neg", "auxpass"])
        return rows.withColumn(name, F.when(taken, array).otherwise(written))

    rows = put("_dep", "_object", F.lit("dobj"))
    rows = put("_dep", "_subject", F.col("_as"))
    written = F.concat(F.slice("_dep", F.lit(1), root), F.array(F.lit("ROOT")),
                       F.slice("_dep", root + 2, F.array_size("_dep")))

    def head(f: Column, i: Column) -> Column:
        return (F.when(i == root, F.lit(None).cast("int"))
                .when(rules.has(f, rules.NEGATION), root).when(helper(f, i), i + 1)
                .when(rules.has(f, rules.FORWARD) & (i + 1 < F.array_size(following)),
                      F.get(following, i + 1))
                .otherwise(root))

    def aspect(t: Column, i: Column) -> Column:
        perfect = rules.has(t["flag"], rules.ED) & flagged(i - 1, rules.HAVE)
        return F.when(t["aspect"].isNotNull(), t["aspect"]).when(perfect, "Perf")

    return rows.select(
        *others, F.when(F.array_size("tok") > 0, written).otherwise(F.col("_dep")).alias("dep"),
        F.transform(flag, head).alias("head"), F.transform("tok", aspect).alias("aspect"))


def token_table(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                model: tagger.Tagger | None = None, columns: Sequence[str] = TABLE_COLUMNS) -> DataFrame:
    """The token table of ``docs``: (keys, sent_id, ``columns``), by default all TABLE_COLUMNS.

    The exchange moves each text once; gathering sentences reuses it, as does any grouping of the
    result by ``keys``.  Only what ``columns`` ask for is gathered, as the optimizer cannot see into the
    gathered records; where they ask for nothing of a word's neighbours, rows stay flat.
    """
    docs = by_keys(docs.select(*keys, text), keys, text)
    words = word_tokens(docs, keys, text, model=model)
    names = {"dep": "t.dep", "head_idx": "t.head", "aspect": "t.aspect"}
    asked = [n for n in names if n in columns]
    if not asked:
        return words.filter("tok_idx is not null").select(*keys, "sent_id", *columns)
    held = {*columns, "pos", "aspect", "flag", "label"}
    rows = relate(gather(words, keys, [c for c in WORD_COLUMNS if c in held]))
    one = F.explode(F.arrays_zip("tok", *[names[n].removeprefix("t.") for n in asked])).alias("t")
    rows = rows.select(*keys, "sent_id", one)
    return rows.select(*keys, "sent_id", *[
        F.col(names.get(c, f"t.tok.{c}")).alias(c) for c in columns])


def of_token_table(tokens: DataFrame, sentences: DataFrame, keys: Sequence[str] = ("doc_id",)
                   ) -> DataFrame:
    """A caller's token table and sentence table (keys, sent_id, text) as token rows."""
    keys = [*keys, "sent_id"]
    lengths = sentences.select(*keys, F.length("text").alias("n_chars"))
    words = tokens.withColumn("lower", F.lower("text")).withColumn("base", F.lower("lemma"))
    return lengths.join(words, keys, "left")
