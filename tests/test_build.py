"""What an index is built by: no text is joined or shuffled, and terms are counted within their rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorebase.operators import index as indexing
from lorebase.operators import search
from lorebase.plans import adapter, catalogue, options

DATA = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def index(spark):
    return catalogue._index(spark, DATA)


def test_postings_take_no_shuffle(index):
    for text in (plan(index.postings), plan(index.among(F.col("term").isin("the"), terms="term = 'the'"))):
        assert "Aggregate" not in text and "Join" not in text and "Repartition" not in text


def test_statistics_join_nothing(index):
    assert "Join" not in plan(index.term_stats) and "Join" not in plan(index.field_stats)


def test_documents_are_joined_without_their_texts(spark):
    text = plan(adapter.tables(spark, DATA)[0])
    assert "Join" in text and "coalesce(text" not in text.split("Join")[0]


def test_rows_given_wide_and_joined_rows_have_the_same_postings(spark, index):
    joined = indexing.build(*adapter.tables(spark, DATA))
    names = ["field", "term", "section_id", "document_id", "strict", "dl", "tf"]
    assert Counter(map(tuple, index.postings.select(names).collect())) == Counter(map(tuple, joined.postings.select(names).collect()))


def test_counts_within_rows(spark):
    rows = [("a#s0", "a", True, "body", ["b", "a", "b", "b", "ä"]), ("a#s0", "a", True, "title", []), ("b#s0", "b", None, "body", ["b"])]
    lengths = spark.createDataFrame(rows, "section_id string, document_id string, strict boolean, field string, tokens array<string>")
    got = {tuple(r) for r in indexing.tallied(lengths).collect()}
    assert got == {("body", "a", "a#s0", "a", True, 5, 1), ("body", "b", "a#s0", "a", True, 5, 3), ("body", "ä", "a#s0", "a", True, 5, 1), ("body", "b", "b#s0", "b", None, 1, 1)}
    assert {tuple(r) for r in indexing.tallied(lengths, "term IN ('b', 'x')").collect()} == {g for g in got if g[1] == "b"}


def test_lookups_read_the_texts_once(spark, index):
    """The dictionary of a search is cut to what the query can meet, for all its alternatives."""
    o = options.validate("q", {})
    rows = search.query_terms({0: "the lichen", 1: "und"}, o)
    held = search._looked_up(index, rows, o)
    assert "RegExp" not in plan(held.term_stats) and "regexp_extract_all" not in plan(held.term_stats)
    terms = {r.term for r in held.term_stats.collect()}
    every = {r.term for r in index.term_stats.collect()}
    assert terms == {t for t in every if t in ("the", "lichen", "und") or t.startswith(("lichen", "und"))}


def test_fuzzy_terms_meet_an_unstored_dictionary_without_neighbourhoods(index):
    o = options.validate("q", {"fuzzy": True})
    assert "variant" not in plan(search.alternatives(index, search.query_terms({0: "ertionthe"}, o), o))


def test_more_alternatives_than_the_driver_takes_are_pruned_and_searched_alike(spark, index, monkeypatch):
    from lorebase.sources import store

    stored = store.stored(index, fuzzy=False)
    texts = {0: "the and", 1: "und der die", 2: "lichen", 3: "que th"}
    for given in ({"limit": 5}, {"limit": 5, "fuzzy": 0.2}, {"limit": 3, "match": "all", "fields": ["title", "body"]}):
        o = options.validate("q", given)
        rows = search.query_terms(texts, o)
        monkeypatch.setattr(search, "EXPANSIONS", 20_000)
        want = {(r.query_id, r.rank, r.section_id, r.score) for r in search.search_many(stored, texts, o).collect()}
        monkeypatch.setattr(search, "EXPANSIONS", 3)
        frame, met = search.expand(stored, rows, o)
        assert met is None and want
        got = search.ranked(search.scores(search.pruned(stored, met, o, frame), o), o)
        assert {(r.query_id, r["rank"], r.section_id, float(round(r.score, 6))) for r in got.collect()} == want
        for one in (stored, index):
            assert {(r.query_id, r.rank, r.section_id, r.score) for r in search.search_many(one, texts, o).collect()} == want


def test_segments_that_are_not_stored_count_alike_and_store_nothing(spark, index, monkeypatch):
    from lorebase.operators import segments
    from lorebase.sources import shared, store

    gone = index.documents.where("type = 'en'").select("document_id")
    stored = segments.combined(segments.changed([segments.segmented(store.stored(index, fuzzy=False))], gone, None))
    monkeypatch.setattr(shared, "cut", None)
    monkeypatch.setattr(store, "stored", None)
    planned = segments.combined(segments.changed([segments.planned(index)], gone, None))
    for name, columns in (("inventory", ["kind", "value", "n"]), ("term_stats", ["field", "term", "df"])):
        rows = lambda i: {tuple(r) for r in getattr(i, name).select(columns).collect()}
        assert rows(planned) == rows(stored)
    assert planned.postings.count() == stored.postings.count() == planned.among(F.lit(True)).count()


def test_postings_are_not_sorted_to_meet_their_frequencies(spark):
    text = catalogue.QUERIES["bm25_components"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("given", [{}, {"fuzzy": 0.2, "fields": ["title", "body"], "where": {"types": ["en"]}}])
def test_scores_of_an_unstored_index_follow_from_one_pass_over_its_texts(spark, index, monkeypatch, given):
    o = options.validate("q", {"limit": 50} | given)
    texts = {0: "lichn thhe", 1: "ertionthe and"}
    rows = search.query_terms(texts, o)
    held = search.gathered(index, rows, o)
    for frame in (held.postings, held.term_stats, held.field_stats, search.matches(index, rows, o)):
        assert "regexp_extract_all" not in plan(frame)
    assert held.averages == index.averages
    one = lambda: Counter(map(str, search.search_many(index, texts, o).collect()))
    found = one()
    # as by the whole dictionary
    monkeypatch.setattr(search, "gathered", lambda index, rows, o: index)
    assert found and found == one()


def test_gathered_terms_are_all_that_query_terms_meet(index):
    o = options.validate("q", {"fuzzy": 1})
    rows = search.query_terms({0: "das", 1: "ab tion", 2: "src3"}, o)
    want = {tuple(r) for r in search.alternatives(index, rows, o).collect()}
    assert want and {tuple(r) for r in search.alternatives(search.gathered(index, rows, o), rows, o).collect()} == want


def test_larger_tables_are_sorted_in_more_ranges(spark, index, monkeypatch):
    from lorebase.sources import store

    monkeypatch.setattr(indexing, "RANGE", 2_000)  # for 4 shuffle partitions
    held = store.stored(index)
    for frame, rows in ((held.parts[0].blocks, held.postings.count()), (held.variants, held.variants.count())):
        assert rows > 8_000 and len(frame.inputFiles()) > 4
    assert held.postings.count() == index.postings.count()


def test_blocks_alone_are_stored_without_other_tables(spark, index, monkeypatch):
    from lorebase.sources import store

    written, real = [], store._write
    monkeypatch.setattr(store, "_write", lambda frame, table, *a: written.append(table) or real(frame, table, *a))
    found = catalogue.QUERIES["postings_blocks"](spark, DATA)
    assert set(written) == {"blocks", "field_stats"}
    assert Counter(found.collect()) == Counter(index.postings.select(found.columns).collect())


def test_ranges_grow_before_they_are_more_than_are_dealt_unheld(spark, monkeypatch):
    monkeypatch.setattr(indexing, "RANGE", 1)
    monkeypatch.setattr(indexing, "DEALT", 6)
    monkeypatch.setattr(indexing, "MOST", 1_000)
    for rows, parts in ((5, 5), (100, 6), (6_000, 6), (10_000, 10)):  # for 4 shuffle partitions
        assert indexing.dealt(spark.range(rows), rows, "id").rdd.getNumPartitions() == parts
