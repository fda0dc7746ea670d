"""Token tables of chosen columns, and the queries that ask for few."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plainread.operators import annotate, document, latent, syntax
from plainread.session import materialize

TEXTS = [(1, "The old dog was chased by cats. It had not seen them before. Dogs run and cats run!"),
         (2, "12 34 ... !"), (3, None), (4, ""), (None, "Running men ran. Men run."), (1, "A second text of one key. It runs.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def table(docs):
    return materialize(annotate.token_table(docs.filter("doc_id is null or text not like 'A second%'")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("columns", [["lemma", "is_alpha"], ["tok_idx", "pos", "head_idx"],
                                     ["lemma", "pos", "dep", "is_alpha"], ["aspect", "text", "syllables"]])
def test_chosen_columns_are_those_of_the_whole_table(docs, table, columns):
    some = annotate.token_table(docs.filter("doc_id is null or text not like 'A second%'"), columns=columns)
    assert some.columns == ["doc_id", "sent_id", *columns]
    key = str
    assert sorted(some.collect(), key=key) == sorted(table.select(*some.columns).collect(), key=key)


def test_what_is_not_asked_for_is_not_computed(docs):
    """syllables were counted and every column gathered, whatever was used of the table."""
    flat = plan(annotate.token_table(docs, columns=["lemma", "is_alpha"]))
    assert "collect_list" not in flat and "[aeiouy" not in flat
    few = plan(annotate.token_table(docs, columns=["tok_idx", "pos", "head_idx"]))
    assert "collect_list" in few and "[aeiouy" not in few and "lemma" not in few.split("collect_list")[1]


def test_lemma_sets_gather_distinct_lemmas(docs):
    """five sets were gathered from every token row."""
    rows = annotate.token_table(docs, columns=["lemma", "pos", "dep", "is_alpha"]).withColumn("base", F.lower("lemma"))
    sets = document.lemma_sets(rows)
    assert "collect_set" not in plan(sets) and "bool_or" in sets._jdf.queryExecution().analyzed().toString()
    assert plan(sets).count("Exchange hashpartitioning") == 1
    found = {r["doc_id"]: r for r in sets.collect()}
    assert found[2]["all_stems"] == [] and 3 not in found and found[None]["verb_lemmas"] == ["run", "runn"]
    kinds = {"content_lemmas": F.col("pos").isin("NOUN", "VERB", "ADJ", "ADV"), "noun_lemmas": F.col("pos") == "NOUN",
             "all_stems": F.lit(True), "argument_lemmas": F.col("dep").isin("nsubj", "dobj")}
    for name, test in kinds.items():
        for doc, r in found.items():
            of = rows.filter(F.col("doc_id").eqNullSafe(F.lit(doc)) & F.col("is_alpha") & test)
            assert r[name] == sorted({x["base"] for x in of.collect()}), (name, doc)


def test_syntactic_similarity_of_rows_that_lie_together(docs, table):
    """the token rows were shuffled again though they already lay by document."""
    rows = annotate.token_table(docs.filter("doc_id is null or text not like 'A second%'"), columns=["tok_idx", "pos", "head_idx"])
    here = syntax.syntactic_similarity(rows, clustered=True)
    assert plan(here).count("Exchange hashpartitioning") == 1
    assert sorted(here.collect(), key=str) == sorted(syntax.syntactic_similarity(table).collect(), key=str)


def test_latent_cells_of_flat_rows(docs, table):
    """the cells need no table of heads; one row a sentence all the same."""
    def cells(rows):
        return sorted((r["doc_id"] or 0, r["sent_id"], sorted(r["cells"])) for r in latent.cell_rows(rows, width=64).collect())

    flat = annotate.token_table(docs.filter("doc_id is null or text not like 'A second%'"), columns=["lemma", "is_alpha"])
    assert cells(flat) == cells(table) and any(c == [] for _, _, c in cells(flat))


def test_products_of_the_latent_model_fit_a_cache():
    """65,536 entries were multiplied at once, 40 MB of products; a sentence may go over several portions."""
    assert latent.AT_ONCE * (latent.RANK + latent.SPARE) * 8 <= 2 << 20
    rng = np.random.default_rng(0)
    lists = [rng.permutation(4096)[:3000].tolist(), [], [5, 5, 7], rng.integers(0, 4096, 2500).tolist()]
    idf, block = rng.random(4096) + 0.5, rng.standard_normal((4096, 6))
    dense = np.array([np.bincount(x, minlength=4096) if x else np.zeros(4096) for x in lists]) * idf
    out, _ = latent.projected(pa.array(lists, pa.list_(pa.int32())), idf, block)
    assert out == pytest.approx(dense @ block, abs=1e-9)
