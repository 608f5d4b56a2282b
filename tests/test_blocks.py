import os
import random
import re

import pytest
from lorebase.errors import ConceptError
from lorebase.functions.edit_distance import distance
from lorebase.operators import index as indexing
from lorebase.operators import search
from lorebase.plans.options import BOOSTS, FIELDS, validate
from lorebase.sources import shared, store
from pyspark.sql import functions as F

some = random.Random(8)
WORDS = ["memory", "memories", "kiln", "the", "of", "load", "search", "lichen", "zebra", "café", "日本語", "a", "stone"]


def corpus(spark, n=120, words=WORDS):
    """Documents with sections of any length, in which some words are very common."""
    documents, sections = [], []
    for i in range(n):
        name = f"d{i:03}"
        documents.append((name, f"{name}.md", some.choice(["Note", "Guide"]), " ".join(some.choices(words, k=3)), [some.choice(["x", "y"])], "stable", "unverified", None, True, some.choice(["strict", "degraded"]), "r", "", ""))
        for k in range(some.randrange(1, 5)):
            text = " ".join(some.choices(words, weights=[2 ** (len(words) - j) for j in range(len(words))], k=some.choice([1, 3, 3, 20, 60])))
            owner = "stray" if some.random() < 0.1 else name  # ids need not begin with their document's
            sections.append((f"{owner}#{i}-{k}", name, " ".join(some.choices(words, k=2)), text, 1 + k, 1 + k))
    return indexing.build(spark.createDataFrame(documents, indexing.DOCUMENT), spark.createDataFrame(sections, indexing.SECTION))


@pytest.fixture(scope="module")
def pair(spark, request):
    patch = pytest.MonkeyPatch()
    patch.setattr(indexing, "BLOCK", 8)
    plain = corpus(spark).cached()
    yield plain, store.stored(plain)
    patch.undo()
    plain.release()


def test_blocks_hold_the_postings_in_order_of_impact(pair):
    plain, stored = pair
    names = [f.split()[0] for f in indexing.POSTING.split(", ")]
    rows = lambda i: sorted(map(tuple, i.postings.select(names).collect()))
    assert rows(plain) == rows(stored)
    assert sorted(map(tuple, plain.term_stats.select("field", "term", "df").collect())) == sorted(map(tuple, stored.term_stats.select("field", "term", "df").collect()))
    mean = {r.field: r.avg_dl for r in plain.field_stats.collect()}
    impact = lambda f, tf, dl: tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean[f]))
    by: dict = {}
    for b in stored.parts[0].blocks.collect():
        assert b.n == len(b.sections) == len(b.tf) <= 8 and list(b.sections) == sorted(b.sections)
        assert {(p.tf, p.dl) for p in b.peaks} == {(t, min(d for u, d in zip(b.tf, b.dl, strict=True) if u == t)) for t in b.tf}
        by.setdefault((b.term, b.field), []).append((b.block, b.head, max(impact(b.field, t, d) for t, d in zip(b.tf, b.dl, strict=True)), min(impact(b.field, t, d) for t, d in zip(b.tf, b.dl, strict=True))))
    for own in by.values():
        own.sort()
        assert own[0][1] and all(a[3] >= b[2] - 1e-12 for a, b in zip(own, own[1:], strict=False))


def test_a_frequent_term_lies_in_many_files(spark, pair):
    plain, _ = pair
    often = plain.postings.where("field = 'body' and term = 'memory'").select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"), "*").withColumn("section_id", F.concat_ws("-", "section_id", "k")).drop("k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = indexing.blocked(shared.cut(often), {"body": 20.0})
        at = shared.folder(spark)
        frame.write.parquet(at)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    held = spark.read.parquet(at).where("term = 'memory'").groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()
    assert len(held) >= 4 and max(r.n for r in held) < 0.5 * sum(r.n for r in held)


QUERIES = {0: "the memory", 1: "memory", 2: "kiln lichen of", 3: "zebra", 4: "memory memories search", 5: "sto", 6: "a the of load", 7: "nothing", 8: "café 日本語", 9: "note guide"}


@pytest.mark.parametrize("given", [
    {}, {"match": "all"}, {"limit": 1}, {"limit": 50}, {"fuzzy": True}, {"fields": ["body"], "limit": 3}, {"where": {"types": ["Note"]}, "limit": 4}, {"fields": ["type"], "limit": 7}, {"fuzzy": 0.4, "match": "all", "limit": 5},
    {"boost": {"body": 10, "title": 0.1}}, {"boost": {f: 1.0 for f in FIELDS}, "limit": 6},
])
def test_pruned_searches_equal_full_ones(pair, monkeypatch, given):
    plain, stored = pair
    calls = []
    real = search.pruned
    monkeypatch.setattr(search, "pruned", lambda *a: calls.append(1) or real(*a))
    o = validate("q", given)
    want = [tuple(r) for r in search.search_many(plain, QUERIES, o).orderBy("query_id", "rank").collect()]
    for threshold in (0, 10**9):
        monkeypatch.setattr(search, "PRUNE_FROM", threshold)
        assert [tuple(r) for r in search.search_many(stored, QUERIES, o).orderBy("query_id", "rank").collect()] == want and want
    assert len(calls) == 1
    # and after changes: removed documents, new ones with other statistics
    gone = [f"d{i:03}" for i in range(0, 120, 3)]
    new = corpus(plain.documents.sparkSession, 20)
    monkeypatch.setattr(search, "PRUNE_FROM", 10**9)
    fresh = new.documents.withColumn("document_id", F.concat(F.lit("new"), "document_id")).withColumn("path", F.concat(F.lit("new"), "path")), new.sections.withColumn("document_id", F.concat(F.lit("new"), "document_id")).withColumn("section_id", F.concat(F.lit("new"), "section_id"))
    changed = indexing.patched(stored, gone, *map(shared.cut, fresh))
    want = [tuple(r) for r in search.search_many(changed, QUERIES, o).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "PRUNE_FROM", 0)
    assert [tuple(r) for r in search.search_many(changed, QUERIES, o).orderBy("query_id", "rank").collect()] == want


def test_a_common_term_is_read_in_part(pair):
    _, stored = pair
    o = validate("memory", {"fields": ["body"], "limit": 3})
    rows = search.query_terms({0: "memory"}, o)
    _, met = search.expand(stored, rows, o)
    exact = [m for m in met if m[4] is None]
    need = search.limits(stored, exact, o, search.floors(stored, exact, o))
    kept = search.reaching(stored, exact, o, need)(stored.parts[0].blocks.where("term = 'memory' and field = 'body'")).count()
    every = stored.parts[0].blocks.where("term = 'memory' and field = 'body'").count()
    assert every >= 15 and kept <= 0.35 * every
    # a term that alone can't make a hit gives no candidates, only what it adds to those of the others
    o = validate("q", {"fields": ["body"], "boost": {"body": 1}, "limit": 2})
    _, met = search.expand(stored, search.query_terms({0: "memory search"}, o), o)
    need = search.limits(stored, [m for m in met if m[4] is None], o, {0: 1.0})
    assert need[0, 0, "body"] is None and need[0, 1, "body"] is not None


def test_neighbourhoods_meet_all_terms_within_two_edits(spark):
    word = lambda: "".join(some.choice("abc") for _ in range(some.choice([1, 2, 3, 5, 6, 7, 8, 9, 12])))
    terms = sorted({word() for _ in range(250)} | {"日本語テキスト検索", "日本テキスト検索", "ab", "ba"})
    held = indexing.neighbourhoods(spark.createDataFrame([(t, "body") for t in terms], "term string, field string")).collect()
    whole, begun = {}, {}
    for r in held:
        (whole if r.term is not None else begun).setdefault(r.variant, set()).add(r.term if r.term is not None else r.stem)
    asked = [word() for _ in range(60)] + ["日本語テキスト", "テ", "ab"]
    for q in asked:
        for reach in (1, 2):
            near = [v for v in indexing.deletions(q) if min(len(q), indexing.STEM) - len(v) <= reach]
            met = {t for v in near for t in whole.get(v, ()) if min(len(t), indexing.STEM) - len(v) <= reach}
            assert {t for t in terms if distance(q, t) <= reach} <= met
            stems = {s for v in near for s in begun.get(v, ()) if len(s) - len(v) <= reach}
            assert all(any(t[:n] in stems for n in range(1, indexing.STEM + 1)) for t in terms if min(distance(q, t[:n]) for n in range(1, len(t) + 1)) <= reach)
    assert max(len(t) for t in terms) > indexing.STEM


def test_fuzzy_plans_have_no_nested_loops(spark, pair):
    _, stored = pair
    o = validate("q", {"fuzzy": True})
    rows = search.query_terms({0: "memry srch", 1: "lichn zebr"}, o)
    plan = search.alternatives(stored, rows, o)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan) and "variant" in plan
    found = {(r.query_id, r.pos, r.index_term, r.weight) for r in search.alternatives(stored, rows, o).collect()}
    terms = {r.term for r in stored.term_stats.select("term").distinct().collect()}
    want = set()
    for q, pos, term, reach, prefix, _ in rows:
        want |= {(q, pos, t, search.FUZZY_WEIGHT) for t in terms if distance(term, t) <= reach}
        want |= {(q, pos, t, search.PREFIX_WEIGHT) for t in terms if prefix and distance(term, t, True) <= reach}
    assert found == want and {t for _, _, t, _ in found} >= {"memory", "lichen", "zebra"}


def test_damage_is_found_and_placed(spark, pair, monkeypatch):
    plain, _ = pair
    monkeypatch.setattr(store, "LEAF", 16)
    cache = shared.folder(spark)
    store.save(plain, cache)
    assert store.load(spark, cache).documents.count() == 120 and store.damaged(spark, cache).collect() == []
    folder = store._manifest(spark, cache)[1]
    files = store._digests(spark, folder)
    assert {n.split("/")[0] for n in files} == set(store.TABLES) and all(length > 0 and len(digest) == 64 for length, digest in files.values())
    # other content of the same columns in one file, in the second half
    victim = next(f"{folder}/{n}".removeprefix("file:").replace("//", "/") for n in files if n.startswith("sections/"))
    import pyarrow.parquet as pq

    table = pq.read_table(victim)
    assert len(table) > 32
    texts = table.column("text").to_pylist()
    texts[20] = "changed"
    schema = table.schema
    pq.write_table(table.set_column(schema.get_field_index("text"), "text", [texts]), victim)
    crc = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    (bad,) = store.damaged(spark, cache).collect()
    assert (bad.file.split("/")[0], bad.first_row, bad.last_row) == ("sections", 16, 31)
    with pytest.raises(ConceptError) as e:
        store.load(spark, cache)
    assert e.value.code == "ERR_CACHE_INVALID"
    assert BOOSTS


def test_a_saved_index_is_digested_once_and_verified_without_its_postings_again(spark, pair, monkeypatch):
    plain, stored = pair
    digested, real = [], store.leaves
    monkeypatch.setattr(store, "leaves", lambda *a: digested.append(1) or real(*a))
    store._written(plain, store.Place(spark, shared.folder(spark)))
    assert len(digested) == 1
    found = store.verify(stored)
    assert "arrays_zip" not in found._jdf.queryExecution().optimizedPlan().toString() and found.isEmpty()
