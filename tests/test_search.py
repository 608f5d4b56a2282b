import math
from collections import Counter

import pytest
from lorebase.operators import index as indexing
from lorebase.operators import search, stats
from lorebase.operators.suggest import suggest
from lorebase.plans import options
from lorebase.plans.options import BOOSTS, tokens, validate

MATRIX = [  # document_id, type, conformance, tags, status, stale_after_epoch, classified, trust_tier
    ("anvil", "Tool", "strict", ["iron", "heavy"], "stable", 500, True, "human-reviewed"),
    ("bellows", "Part", "strict", ["iron", "leather"], "draft", 2500, True, "machine-confirmed"),
    ("chisel", "Note", "strict", ["iron"], "stable", None, True, "unverified"),
    ("dross", "Note", "degraded", ["iron"], None, None, False, None),
]


def make(spark, documents, sections):
    rows = [(i, f"{i}.md", kind, i, tags, status, trust, epoch, classified, conformance, "", "", "") for i, kind, conformance, tags, status, epoch, classified, trust in documents]
    return indexing.build(spark.createDataFrame(rows, indexing.DOCUMENT), spark.createDataFrame(sections, indexing.SECTION))


@pytest.fixture(scope="module")
def matrix(spark):
    return make(spark, MATRIX, [(f"{d[0]}#root", d[0], d[0], "Some iron from the forge.", 1, 3) for d in MATRIX]).cached()


def found(index, query, given=None):
    return [(r.document_id, r.score) for r in search.search_many(index, {0: query}, validate(query, given)).orderBy("rank").collect()]


ALL = {d[0] for d in MATRIX}
@pytest.mark.parametrize("where,as_of,want", [
    ({"types": ["Tool", "Part"]}, 499, {"anvil", "bellows"}), ({"tagsAny": ["leather", "none"]}, 499, {"bellows"}), ({"statuses": ["stable"]}, 499, {"anvil", "chisel"}),
    ({"trustTiers": ["machine-confirmed"]}, 499, {"bellows"}), ({"conformance": ["degraded"]}, 499, {"dross"}), ({"statuses": [], "types": [], "trustTiers": []}, 499, ALL),
    ({"stale": True}, 499, set()), ({"stale": True}, 500, {"anvil"}), ({"stale": True}, 2500, {"anvil", "bellows"}),
    ({"stale": False}, 499, {"chisel", "anvil", "bellows"}), ({"stale": False}, 500, {"chisel", "bellows"}), ({"stale": False}, 2500, {"chisel"}),
])
def test_filters(matrix, where, as_of, want):
    kept = matrix.documents.where(options.condition(o)) if options.condition(o := validate("", {"where": where, "asOf": as_of})) is not None else matrix.documents
    assert {r.document_id for r in kept.collect()} == want


def test_filters_apply_before_the_limit_and_leave_scores(matrix):
    whole = dict(found(matrix, "iron", {"fields": ["body"]}))
    assert set(whole) == ALL and len(set(whole.values())) == 1
    ((kept, score),) = found(matrix, "iron", {"fields": ["body"], "limit": 1, "where": {"types": ["Note"], "conformance": ["degraded"]}})
    assert kept == "dross" and score == whole[kept]
    assert [d for d, _ in found(matrix, "iron", {"fields": ["body"]})] == ["anvil", "bellows", "chisel", "dross"]  # strict first, then by id


def test_statistics(matrix):
    assert stats.totals(matrix.documents).first().asDict() == {"total": 4, "strict": 3, "degraded": 1}
    assert [tuple(r) for r in stats.types(matrix.documents).collect()] == [("Note", 2), ("Part", 1), ("Tool", 1)]
    assert stats.statuses(matrix.documents).first().asDict() == {"draft": 1, "stable": 2, "deprecated": 0, "unclassified": 1}
    assert stats.trust_tiers(matrix.documents).first().asDict() == {"unverified": 1, "machine_confirmed": 1, "human_reviewed": 1, "unclassified": 1}
    assert [r.document_id for r in stats.degraded(matrix.documents).collect()] == ["dross"]


CORPUS = [("a", "Alpha retrieval guide", "Memory search finds retrieval notes quickly. memory"), ("b", "Beta", "Searching memories, searchable memory and rertieval"), ("c", "Gamma café", "Kiln loading: load the kiln slowly"), ("d", "Delta 日本語", "A café in 日本語 text search"), ("e", "Search", "x")]


@pytest.fixture(scope="module")
def corpus(spark):
    documents = [(i, "Note", "strict", ["t"], "stable", None, True, "unverified") for i, *_ in CORPUS]
    return make(spark, documents, [(f"{i}#s{k}", i, heading, part, 1 + k, 1 + k) for i, heading, text in CORPUS for k, part in enumerate(text.split(". "))]).cached()


def plain(index, query, o):
    """Scores of all sections by the formula alone."""
    from lorebase.functions.edit_distance import distance

    documents = {r.document_id: r for r in index.documents.collect()}
    records = {}
    for s in index.sections.collect():
        d = documents[s.document_id]
        texts = {"title": d.title, "type": d.type, "tags": "\n".join(d.tags), "resource": d.resource, "heading": s.heading_path, "description": d.description, "sources": d.source_text, "body": s.text}
        records[s.section_id] = {f: tokens(t) for f, t in texts.items()}
    n = len(records)
    out = {}
    asked = search.query_terms({0: query}, o)
    for section, fields in records.items():
        total, met = 0.0, set()
        for _, pos, term, reach, prefix, _ in asked:
            for f in o.fields:
                own, best = Counter(fields[f]), []
                df = sum(term in r[f] for r in records.values())
                avg = sum(len(r[f]) for r in records.values()) / n
                if own[term]:
                    tf = own[term]
                    best.append(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(fields[f]) / avg)))
                if reach and any(distance(term, t) <= reach for t in own):
                    best.append(0.7)
                if prefix and any(t.startswith(term) or (reach and o.fuzzy_prefix and distance(term, t, True) <= reach) for t in own):
                    best.append(0.5)
                if best:
                    total += o.boost[f] * max(best)
                    met.add(pos)
        if met and (o.match == "any" or len(met) == len(asked)):
            out[section] = round(total, 5)
    return out


@pytest.mark.parametrize("query,given", [
    ("memory search", {}), ("memory search", {"match": "all"}), ("sear", {}), ("se", {}), ("retrieval", {"fuzzy": True}), ("memry srch", {"fuzzy": 0.3, "match": "all"}), ("café 日本語", {}),
    ("search kiln", {"fields": ["body", "heading"], "boost": {"heading": 0.1, "body": 10}}), ("memory memory", {}), ("retreival mem", {"fuzzy": 1}),
])
def test_scores_equal_the_formula(corpus, query, given):
    o = validate(query, given)
    rows = search.scores(search.matches(corpus, search.query_terms({0: query}, o), o), o).collect()
    assert {r.section_id: round(float(r.score), 5) for r in rows} == plain(corpus, query, o)


def test_hits_show_best_section_fields_and_snippet(corpus):
    (hit,) = search.search_many(corpus, {7: "quickly"}, validate("q", {"fields": ["body", "title"]})).collect()
    assert (hit.query_id, hit.rank, hit.document_id, hit.section_id, hit.matched_fields, hit.snippet) == (7, 1, "a", "a#s0", ["body"], "Memory search finds retrieval notes quickly")
    many = search.search_many(corpus, {0: "memory", 1: "kiln", 2: "!!"}, validate("q")).collect()
    assert {r.query_id for r in many} == {0, 1} and len({(r.query_id, r.document_id) for r in many}) == len(many)
    assert search.search_many(corpus, {0: " .,"}, validate("q")).collect() == [] == search.search_many(corpus, {0: "memory"}, validate("q", {"limit": 0})).collect()


@pytest.mark.parametrize("text,anchor,length,want", [
    ("load the kiln at dawn", 9, 8, "load the…"), ("ash and oak", None, 5, "ash a…"), ("k🔥w", None, 2, "k…"), ("🔥🔥k", None, 4, "🔥🔥…"), ("kiln🔥", None, 6, "kiln🔥"),
    ("д" * 95 + "kiln" + "o" * 90, 95, 120, "…" + "д" * 80 + "kiln" + "o" * 36 + "…"), ("🔥" * 60 + "k", 60, 6, "…" + "🔥" * 3 + "…"),
])
def test_snippets(text, anchor, length, want):
    assert search.window(text, anchor, length) == want


def test_anchor_is_the_first_token_that_any_term_accepts():
    assert search.anchor("Some rertieval, then retrieval", [("retrieval", 0, False)], True) == 21
    assert search.anchor("Some rertieval, then retrieval", [("retrieval", 1, False)], True) == 5
    assert search.anchor("İstanbul memories", [("memo", 0, True)], True) == 9
    assert search.anchor("none", [("memory", 1, True)], True) is None


def test_suggestions(corpus):
    got = lambda q, given=None: [r.suggestion for r in suggest(corpus, q, validate(q, given, suggest=True)).collect()]
    assert got("kiln lo") == ["kiln loading load"] and got("kiln z") == [] and got(" ..") == [] and "memory" in got("memory z", {"match": "any"})
    assert len(got("s", {"limit": 1})) == 1


@pytest.mark.parametrize("given,text", [
    ({"limit": -1, "match": "x"}, "options.limit must be a finite non-negative integer"), ({"limit": True}, "options.limit must be a finite non-negative integer"), ({"limit": 1.5}, "options.limit must be a finite non-negative integer"),
    ({"asOf": "x", "limit": -1}, "options.asOf must be a valid Date"), ({"snippetLength": 0}, "options.snippetLength must be a positive safe integer"), ({"match": "some"}, 'options.match must be "any" or "all"'),
    ({"fields": []}, "options.fields must be a non-empty array"), ({"fields": ["nope"]}, "options.fields must contain only valid SearchField values"), ({"fuzzy": 2}, "options.fuzzy must be a boolean or a finite number between 0 and 1, inclusive"),
    ({"where": 1}, "options.where must be an object"), ({"where": {"x": 1}}, "options.where must contain only valid filter names"), ({"where": {"types": "x"}}, "options.where.types must be an array"),
    ({"where": {"types": [1]}}, "options.where.types must contain only strings"), ({"where": {"statuses": ["x"]}}, "options.where.statuses must contain only valid Status values"), ({"where": {"stale": 1}}, "options.where.stale must be a boolean"),
    ({"boost": 1}, "options.boost must be an object"), ({"boost": {"x": 1}}, "options.boost must contain only valid SearchField keys"), ({"boost": {"title": 11}}, "options.boost.title must be a finite number between 0.1 and 10, inclusive"),
    ({"fuzzy": 2, "boost": 1, "where": 1}, "options.fuzzy must be a boolean or a finite number between 0 and 1, inclusive"),
])
def test_option_errors(given, text):
    with pytest.raises(TypeError) as e:
        validate("", given)
    assert str(e.value) == text


def test_option_defaults():
    assert validate("q").boost == BOOSTS and validate("q", {"boost": {"body": 2}}).boost == BOOSTS | {"body": 2.0}
    assert validate("q", {"fuzzy": True}).fuzzy == 0.2 and validate("q", {"fields": ["body", "title", "body"]}).fields == ("body", "title")
    assert options.edits("memory", validate("q", {"fuzzy": 1})) == 2 and options.edits("ab", validate("q", {"fuzzy": 0.1})) == 1 and options.edits("ab", validate("q")) == 0


def test_score_invariance_covers_all_matches(spark, monkeypatch):
    from lorebase.plans import catalogue

    def cut(*_):
        raise AssertionError("a ranked list ends at its limit")

    monkeypatch.setattr(catalogue.search, "ranked", cut)
    row = catalogue.QUERIES["filter_score_invariance"](spark, "/root/testdata/sf0.001").first()
    assert row.compared > 0 and row.changed == 0
