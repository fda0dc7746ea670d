"""Syntax features of sentence rows (arrays ``dep`` and ``head``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainread.functions import rules
from plainread.functions import wordlists as W


def label_count(dep: Column, *labels: str) -> Column:
    """How often labels occur: size before minus size after removing them."""
    rest = dep
    for label in labels:
        rest = F.array_remove(rest, label)
    return (F.array_size(dep) - F.array_size(rest)).cast("bigint")


def dependency_depth(head: Column) -> Column:
    """Edges on the longest path from the root to a leaf of the head tree.

    Pointer doubling: each round every token adds the distance of the token it
    points at and then points where that one points, so ceil(log2 n) rounds
    reach the root from any depth, in place, without a shuffle.  Rounds are
    bounded, so broken input with a cycle still ends.
    """
    start = F.struct(
        F.transform(head, lambda h, i: F.coalesce(h, i)).alias("to"),
        F.transform(head, lambda h: F.when(h.isNull(), 0).otherwise(1)).alias("far"))
    rounds = F.greatest(F.ceil(F.log2(F.array_size(head).cast("double"))).cast("int"), F.lit(1))

    def double(state: Column, _: Column) -> Column:
        return F.struct(
            F.transform(state["to"], lambda p: F.get(state["to"], p)).alias("to"),
            F.transform(state["far"], lambda d, i: d + F.get(
                state["far"], F.get(state["to"], i))).alias("far"))

    depth = F.aggregate(F.sequence(F.lit(1), rounds), start, double,
                        lambda state: F.array_max(state["far"]))
    return F.coalesce(depth, F.lit(0)).cast("bigint")


def passive_constructions(dep: Column, compat: bool = False) -> Column:
    return F.lit(0).cast("bigint") if compat else label_count(dep, *W.PASSIVE_DEP)


def root_position(dep: Column) -> Column:
    """0-based position of the root token in its sentence."""
    return F.greatest(F.array_position(dep, "ROOT") - 1, F.lit(0)).cast("bigint")


def noun_modifiers(dep: Column, head: Column, compat: bool = False) -> Column:
    """Modifiers that hang on a noun, over the sentence's tokens ``tok`` (compat: 0)."""
    if compat:
        return F.lit(0)
    hangs = F.zip_with(dep, head, lambda d, h: rules.one_of(d, W.MODIFIER_DEP) & rules.one_of(
        F.get("tok", h)["pos"], W.NOUN_POS))
    return F.array_size(F.filter(hangs, lambda x: F.coalesce(x, F.lit(False))))


def syntactic_similarity(tokens: DataFrame, keys: Sequence[str] = ("doc_id",), clustered: bool = False) -> DataFrame:
    """(keys, sent_id, syntactic_similarity_prev): how much of the two trees of a sentence and the one
    before it is the same; 0 for the first sentence.

    A tree is the bag of its ordered one-level subtrees, a token's tag with those of its dependents from left to
    right.  The similarity is twice the number of subtrees in common over that of both trees.  ``tokens`` is a
    token table; every step groups by the document first, so one exchange serves them all, and with ``clustered``
    (``tokens`` lie together by document, as ``annotate.token_table`` leaves them) none is needed.
    """
    place = [*keys, "sent_id"]
    sides = F.array(F.struct(F.col("tok_idx").alias("node"), F.lit(-1).alias("at"), F.col("pos").alias("pos")),
                    F.struct(F.col("head_idx").alias("node"), F.col("tok_idx").alias("at"), F.col("pos").alias("pos")))
    tokens = tokens if clustered else tokens.repartition(*keys)
    rows = tokens.filter("tok_idx is not null").select(*place, F.explode(sides).alias("s"))
    tree = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s.at", "s.pos"))), lambda c: c["pos"]), " ")
    nodes = rows.filter("s.node is not null").groupBy(*place, "s.node").agg(tree.alias("_tree"))
    bags = nodes.groupBy(*place, "_tree").agg(F.count("*").alias("_n"))
    # Each subtree once for its own sentence, once for the next.
    pairs = bags.select(*keys, "_tree", F.explode(F.array(
        F.struct(F.col("sent_id").alias("sent_id"), F.col("_n").alias("now"), F.lit(0).cast("bigint").alias("before")),
        F.struct((F.col("sent_id") + 1).alias("sent_id"), F.lit(0).cast("bigint").alias("now"), F.col("_n").alias("before")),
    )).alias("p")).select(*keys, "p.sent_id", "_tree", "p.now", "p.before")
    both = pairs.groupBy(*place, "_tree").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    found = both.groupBy(*place).agg(F.sum("now").alias("now"), F.sum("before").alias("before"),
                                     F.sum(F.least("now", "before")).alias("common"))
    # A last sentence has no next one.
    same = rules.ratio(2 * F.col("common"), F.col("now") + F.col("before"))
    return found.filter("now > 0").select(*place, F.when(F.col("before") > 0, same).otherwise(0.0).alias(
        "syntactic_similarity_prev"))
