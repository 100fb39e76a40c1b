"""Work on many rows of a small file is dealt over tasks, done once, and sent to no one place."""

import re

import pytest

from quillon import catalog
from quillon.functions import text as T
from quillon.models import generate
from quillon.operators import index as I

RANKED = ("candidate_rank", "low_confidence", "plain_answers", "extractive_answers", "candidate_texts", "selector_prompts", "debug_candidates", "selected_answers", "generated_answers")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RANKED)
def test_units_are_ranked_once_in_dealt_rows(spark, sf, name):
    p = plan(catalog.queries()[name](spark, sf))
    assert p.count("Generate posexplode") == 1 and "BroadcastExchange" not in p
    # rows are exchanged as the table has them; units, features and ranks never
    assert "REPARTITION_BY_NUM" in p
    assert p.count("ENSURE_REQUIREMENTS") == (name == "generated_answers")  # that of the chat history


def test_units_are_dealt(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalog.queries()["candidate_units"](spark, sf).rdd.getNumPartitions() == parts > 2


def test_a_model_is_asked_for_prompts_alone(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, p string").coalesce(1)
    got = d.select("i", generate(d.p, lambda prompts: [f"{len(prompts)}{p}" for p in prompts]).alias("said")).collect()
    assert {r.i: r.said for r in got} == {1: "2a", 2: None, 3: "2"}


def test_white_space_is_what_unicode_calls_so(spark):
    # Python's own list, over all characters that one UTF-16 unit holds
    d = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    for form in ("[{}]", "[{}:]"):
        got = {r.c for r in d.filter(d.c.rlike(form.format(T.WS))).collect()} - {":"}
        assert got == {c for i in range(0x10000) if (c := chr(i)).isspace()}
    assert {r.c for r in d.filter(~d.c.rlike(f"[^{T.WS}]")).collect()} == got


@pytest.mark.parametrize("name", ("bm25_topk", "lexical_rank", "recency_rank", "rank_fusion", "diverse_topk"))
def test_pairs_that_share_a_term_are_not_exchanged(spark, sf, name):
    p = plan(catalog.queries()[name](spark, sf))
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, (chunk_idx|id)#|(chunk_idx|id)#\d+L?, query_id#)", p)
    # texts are tokenized once, into postings: here names are all that is read of documents
    assert not re.search(r"documents.*ReadSchema: struct<[^>]*text", p)


def test_pairs_are_not_sorted_by_names(spark, sf):
    p = plan(catalog.queries()["diverse_topk"](spark, sf))
    assert not re.search(r"Sort \[[^\]]*source_path", p)


def test_dates_are_read_before_pairs_are_joined(spark, sf):
    p = plan(catalog.queries()["recency_rank"](spark, sf))
    lines = [i for i, x in enumerate(p.splitlines()) if "substring_index" in x]
    assert lines and min(lines) > next(i for i, x in enumerate(p.splitlines()) if "ShuffledHashJoin" in x)


def test_texts_are_looked_at_for_tables_where_they_are_dealt(spark, sf):
    p = plan(catalog.queries()["table_groups"](spark, sf)).splitlines()
    looked = next(i for i, x in enumerate(p) if "Generate explode" in x)
    assert looked < next(i for i, x in enumerate(p) if "REPARTITION_BY_NUM" in x)


def test_an_empty_corpus_has_no_scores(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    none = spark.createDataFrame([], "id long, tokens array<string>")
    assert I.bm25_scores(none, q).collect() == [] and I.hits(none, I.query_tokens(q))[1].first().avgdl == 0.0
    some = spark.createDataFrame([(1, ["a", "a", "c"]), (2, []), (3, ["d"])], none.schema)
    postings, stats = I.hits(some, I.query_tokens(q))
    assert [tuple(r) for r in postings.select("id", "dl", "term", "tf", "df").collect()] == [(1, 3, "a", 2, 1)]
    assert stats.first() == I.corpus_stats(some).first()


@pytest.mark.parametrize("name", ("infer_title", "split_sections"))
def test_files_are_dealt(spark, sf, name):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalog.queries()[name](spark, sf).rdd.getNumPartitions() == parts > 1


def test_terms_are_counted_where_texts_are_dealt(spark, sf):
    p = plan(catalog.queries()["term_frequencies"](spark, sf))
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p
