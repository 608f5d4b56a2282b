import json
import os
import random
import threading
import time

import pytest
from lorebase import tool
from lorebase.errors import ConceptError
from lorebase.handle import Snapshots, create_search, from_prepared, open_concepts
from lorebase.operators import index as indexing
from lorebase.sources import documents as sources
from lorebase.sources import store
from lorebase.streaming import upserts


def concept(title, body, extra=""):
    return f"---\ntype: Guide\ntitle: {title}\n{extra}---\n{body}\n"


FILES = {"memory/search.md": concept("Memory search", "# Use\n\nSearch the shared memory.\n\n# Limits\n\nNone yet."), "half.md": concept("Half", "memory of a half", "status: experimental\n"), ".hidden/_kiln.md": concept("Kiln", "Load the kiln.", "tags: [fire]\n")}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        at = tmp_path / "docs" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes((b"\xef\xbb\xbf" if "kiln" in name else b"") + text.encode())
    for name in ("index.md", "log.md", "notes.MD", "x.txt"):
        (tmp_path / "docs" / name).write_text("not a concept")
    os.symlink(tmp_path / "docs/half.md", tmp_path / "docs/link.md")
    return str(tmp_path / "docs")


def titles(handle, query, **given):
    return [r.title for r in handle.search(query, given).collect()]


def test_open_change_save_and_load(spark, root, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    handle = open_concepts(spark, root, cache)
    assert sorted(r.path for r in sources.directory(spark, root).collect()) == [".hidden/_kiln.md", "half.md", "memory/search.md"]
    assert titles(handle, "memory") == ["Memory search", "Half"] and handle.list_types() == ["Guide"] and [d["path"] for d in handle.list_degraded()] == ["half.md"]
    (hit,) = handle.search("shared", {"snippetLength": 10}).collect()
    assert (hit.heading_path, hit.start_line, hit.end_line, hit.snippet) == ("Use", 5, 7, "Search the…")
    before = {r.section_id: r.score for r in handle.search("memory kiln load").collect()}

    view = handle.ingest("./new.md", concept("New", "A memory, new."))
    assert view["title"] == "New" and view["conformance"] == "strict" and "New" in titles(handle, "memory")
    fresh = create_search(sources.in_memory(spark, [*FILES.items(), ("new.md", concept("New", "A memory, new."))]))
    assert [(r.section_id, r.score) for r in handle.search("memory kiln").collect()] == [(r.section_id, r.score) for r in fresh.search("memory kiln").collect()]
    assert handle.remove("new.md") and not handle.remove("new.md")
    assert {r.section_id: r.score for r in handle.search("memory kiln load").collect()} == before
    assert set(handle.ingest("half.md", concept("Half", "whole", "status: nope\n"))) == {"document_id", "path", "diagnostics"}
    for path, text in (("../x.md", ""), ("a.md", "no envelope"), ("a.md", "---\ntitle: q\n---\n")):
        with pytest.raises(ConceptError):
            handle.ingest(path, text)
    assert titles(handle, "whole") == ["Half"] and handle.index_stats()["documents"] == {"total": 3, "strict": 2, "degraded": 1}

    again = open_concepts(spark, "/nowhere", cache)
    assert titles(again, "memory") == ["Memory search", "Half"] and again.index_stats(cache)["storage"]["size_in_bytes"] > 0
    with monkeypatch.context() as patch, pytest.raises(ConceptError) as e:
        patch.setattr(store.Place, "claim", lambda *_: False)  # others are always first
        handle.save(cache)
    assert e.value.code == "ERR_CACHE_BUSY" and sum(p.startswith("gen-") for p in os.listdir(cache)) == 1
    handle.save(cache)
    assert titles(open_concepts(spark, "/nowhere", cache), "whole") == ["Half"]
    generation = store.newest(store.Place(spark, cache))[1]
    victim = next(os.path.join(cache, generation, "documents", p) for p in os.listdir(os.path.join(cache, generation, "documents")) if p.endswith(".parquet"))
    with open(victim, "ab") as f:
        f.write(b"x")
    with pytest.raises(ConceptError) as e:
        open_concepts(spark, root, cache)
    assert e.value.code == "ERR_CACHE_INVALID"


def test_first_failure_in_path_order(spark, root):
    with open(os.path.join(root, "bad.md"), "wb") as f:
        f.write(b"---\ntype: A\n---\n\xff")
    with pytest.raises(ConceptError) as e:
        open_concepts(spark, root)
    assert (e.value.code, e.value.path) == ("ERR_PARSE", "bad.md")
    for rows, want in (([("b.md", "x"), ("a.md", "---\ntitle: t\n---\n")], ("ERR_FIELD", "a.md", "type")), ([("a.md", "x"), ("./a.md", "y")], ("ERR_FIELD", "a.md", "path")), ([("z.txt", "x")], ("ERR_FIELD", "z.txt", "path"))):
        with pytest.raises(ConceptError) as e:
            create_search(sources.in_memory(spark, rows))
        assert (e.value.code, e.value.path, e.value.field) == want


def test_many_documents_streams_poison_and_tool(spark, tmp_path, monkeypatch):
    handle = create_search(sources.in_memory(spark, FILES.items()))
    rows = spark.createDataFrame([("half.md", concept("Half two", "kiln now")), ("../up.md", ""), ("f.md", "fatal"), ("d.md", concept("D", "x", "status: q\n"))], sources.RAW)
    assert {r.path: r.outcome for r in handle.ingest_many(rows).collect()} == {"half.md": "strict", "<input>": "rejected", "f.md": "fatal", "d.md": "degraded"}
    assert sorted(titles(handle, "kiln")) == ["Half two", "Kiln"]

    stream = spark.createDataFrame([("half.md", concept("Half three", "kiln"), 1), ("half.md", concept("Half four", "kiln"), 2), ("d.md", None, 3)], "path string, markdown string, version long")
    stream.write.parquet(str(tmp_path / "in"))
    query = upserts.start(handle, spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in")), str(tmp_path / "progress"))
    query.awaitTermination(120)
    assert sorted(titles(handle, "kiln")) == ["Half four", "Kiln"] and titles(handle, "x") == []

    hits = tool.tool_search(handle, "/root/of", "serch memry", limit=1)
    assert tool.render(hits) == "1 hit\n\n1. Memory search\nHeading: Use\n/root/of/memory/search.md:5-7\nMatched: title, resource, heading, body\nSearch the shared memory.".replace("title, resource, heading, body", ", ".join(hits[0]["matched_fields"])).replace("Search the shared memory.", hits[0]["snippet"])
    assert tool.render([]) == "No matches." and tool.filters(tags=" a, b ,a,", stale=False) == {"tagsAny": ["a", "b"], "stale": False}
    with pytest.raises(TypeError):
        tool.tool_search(handle, "/", " ")
    built = []
    snapshots = Snapshots(lambda: built.append(1) or handle)
    assert snapshots.get() is snapshots.get() is handle and len(built) == 1 and snapshots.status()["degraded"] == 0

    def fail(*_):
        raise RuntimeError

    monkeypatch.setattr(indexing, "patched", fail)
    for _ in range(2):
        with pytest.raises(ConceptError) as e:
            handle.ingest("p.md", concept("P", "p"))
        assert e.value.code == "ERR_INDEX_UNUSABLE"
    with pytest.raises(ConceptError):
        handle.search("kiln")


def test_prepared_tables_are_checked(spark):
    document = ("a", "a.md", "T", "A", [], "stable", "unverified", None, True, "strict", None, None, "")
    section = ("a#root", "a", "A", "text", 1, 2)
    make = lambda d, s: from_prepared(spark.createDataFrame(d, indexing.DOCUMENT), spark.createDataFrame(s, indexing.SECTION))
    assert titles(make([document], [section]), "text") == ["A"]
    wrong = [([document], []), ([document, document], [section]), ([document], [section, section]), ([document], [("a#root", "a", "A", "text", 2, 1)]), ([document[:2] + (" ",) + document[3:]], [section]), ([document[:5] + (None,) + document[6:]], [section]), ([document], [section, ("b#x", "b", "B", "", 1, 1)])]
    for d, s in wrong:
        assert not indexing.violations(spark.createDataFrame(d, indexing.DOCUMENT), spark.createDataFrame(s, indexing.SECTION)).isEmpty()


def test_changes_are_checked_before_and_after(spark, monkeypatch):
    handle = create_search(sources.in_memory(spark, FILES.items()))
    # sections and paths have one owner
    taken = handle._index.sections.where("document_id = 'half'").first().section_id
    one = {"document_id": "other", "path": "other.md", "sections": [{"section_id": taken}]}
    for made in ([one], [{"document_id": "half", "path": "elsewhere.md", "sections": []}], [{"document_id": "else", "path": "half.md", "sections": []}]):
        with pytest.raises(ConceptError) as e:
            handle._conflict(made)
        assert e.value.code == "ERR_FIELD"
    assert titles(handle, "memory") == ["Memory search", "Half"]  # nothing was applied, nothing is poisoned

    assert handle.remove_many(["half.md", "nowhere.md", "./memory/search.md"]) == ["half.md", "memory/search.md"] and titles(handle, "memory") == []
    rows = spark.createDataFrame([("a.md", concept("First", "zebra"), 2), ("./a.md", concept("Second", "zebra"), 1), ("b.md", concept("Third", "zebra"), 1)], "path string, markdown string, version int")
    assert {r.path: r.outcome for r in handle.ingest_many(rows).collect()} == {"a.md": "strict", "b.md": "strict"}
    assert sorted(titles(handle, "zebra")) == ["First", "Third"]
    handle.ingest_many(rows.drop("version").coalesce(1))  # without versions the last one counts
    assert sorted(titles(handle, "zebra")) == ["Second", "Third"]
    before = [(r.section_id, r.score) for r in handle.search("zebra kiln load").collect()]
    handle.merge()
    assert [(r.section_id, r.score) for r in handle.search("zebra kiln load").collect()] == before

    real = indexing.patched
    monkeypatch.setattr(indexing, "patched", lambda base, gone, documents, sections: real(base, gone, documents, sections.limit(0)))
    with pytest.raises(ConceptError) as e:
        handle.ingest("lost.md", concept("Lost", "its sections"))
    assert e.value.code == "ERR_INDEX_UNUSABLE"
    with pytest.raises(ConceptError):
        handle.search("zebra")


def test_large_batches_are_merged_at_once(spark, monkeypatch):
    from lorebase import handle as module

    monkeypatch.setattr(module, "MERGE_AFTER", 2)
    handle = create_search(sources.in_memory(spark, FILES.items()))
    more = [("half.md", concept("Half", "of lichen")), *[(f"n{i}.md", concept(f"N{i}", "lichen too")) for i in range(4)]]
    handle.ingest_many(sources.in_memory(spark, more))
    fresh = create_search(sources.in_memory(spark, (dict(FILES) | dict(more)).items()))
    scores = lambda h: [(r.section_id, r.score) for r in h.search("lichen memory half", {"limit": 50}).collect()]
    assert scores(handle) == scores(fresh) and handle._gone == set() and len(scores(handle)) == 6


def test_one_build_serves_all_who_wait():
    built, go = [], threading.Event()

    def build():
        built.append(1)
        go.wait(30)
        return object()

    snapshots = Snapshots(build, "/root/of")
    with pytest.raises(TimeoutError):
        snapshots.get(timeout=0.05)
    got = []
    threads = [threading.Thread(target=lambda: got.append(snapshots.refresh())) for _ in range(5)]
    for t in threads:
        t.start()
    time.sleep(0.2)
    go.set()
    for t in threads:
        t.join(30)
    assert len(built) == 1 and len({id(x) for x in got}) == 1 and snapshots.get() is got[0]
    snapshots._build = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        snapshots.refresh()
    assert snapshots.get() is got[0]


def test_saved_indexes_are_refused_for_what_is_wrong_with_them(spark, tmp_path):
    cache = str(tmp_path / "cache")
    handle = create_search(sources.in_memory(spark, FILES.items()))
    handle.save(f"file://{cache}")  # a path of any file system
    assert titles(open_concepts(spark, "/nowhere", cache), "memory") == ["Memory search", "Half"]
    commit = f"{cache}/commits/{1:020}"
    pointer = open(commit).read()
    at = f"{cache}/{pointer}/manifest.json"
    good = open(at).read()
    own = json.loads(good)

    def refused(code="ERR_CACHE_INVALID"):
        with pytest.raises(ConceptError) as e:
            store.load(spark, cache)
        assert e.value.code == code

    def put(path, text):
        for name in (path, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")):
            if os.path.exists(name):
                os.remove(name)
        with open(path, "w") as f:
            f.write(text)

    for text, code in (("no json", "ERR_CACHE_INVALID"), ("[]", "ERR_CACHE_INVALID"), (good[:-1] + ', "format": 2}', "ERR_CACHE_INVALID"), (json.dumps(own | {"format": 1}), "ERR_CACHE_INCOMPATIBLE"), (json.dumps(own | {"documents": 9}), "ERR_CACHE_INVALID"),
                       (json.dumps(own | {"schemas": own["schemas"] | {"sections": "struct<a:int>"}}), "ERR_CACHE_INVALID"), (json.dumps(own | {"files": {}}), "ERR_CACHE_INVALID")):
        put(at, text)
        refused(code)
    put(at, good)
    for name in ("../elsewhere", "gen-1", ""):
        put(commit, name)
        refused()
    os.rename(commit, f"{cache}/current")  # as it was before there were commits
    refused("ERR_CACHE_INCOMPATIBLE")
    put(commit, pointer)
    assert not store.load(spark, cache).documents.isEmpty()

    index = handle._index
    wrong = {
        "wrong count of a term": {"term_stats": index.term_stats.withColumn("df", index.term_stats.df + 1)}, "wrong statistics of a field": {"field_stats": index.field_stats.where("field <> 'body'")},
        "section without postings": {"postings": index.postings.where("document_id <> 'half'")}, "posting without section": {"sections": index.sections.where("document_id <> 'half'")},
        "wrong conformance of a posting": {"postings": index.postings.withColumn("strict", ~index.postings.strict)}, "wrong count of documents": {"inventory": index.inventory.where("kind <> 'status'")},
    }
    for rule, change in wrong.items():
        assert rule in {r.rule for r in store.verify(indexing.Index(**index.frames() | change)).collect()}
    os.symlink(cache, tmp_path / "link")
    with pytest.raises(ConceptError) as e:
        handle.save(str(tmp_path / "link"))
    assert e.value.code == "ERR_WRITE"


def test_changes_become_segments_and_nothing_stored_is_rewritten(spark, monkeypatch):
    from lorebase import handle as module
    from lorebase.operators import segments
    from lorebase.operators import search as searching

    monkeypatch.setattr(module, "MERGE_AFTER", 3)
    monkeypatch.setattr(segments, "TIER", 3)
    monkeypatch.setattr(indexing, "BLOCK", 4)
    words = ["memory", "kiln", "lichen", "stone", "the"]
    text = lambda i, k: " ".join(words[(i * k + j) % 5] for j in range(3 + i % 7))
    files = {f"d{i}.md": concept(f"Doc {i}", text(i, 1)) for i in range(30)}
    handle = create_search(sources.in_memory(spark, files.items()))
    written = []
    real = store.stored
    monkeypatch.setattr(store, "stored", lambda index, *a, **b: written.append(index.documents.count()) or real(index, *a, **b))

    def check():
        fresh = create_search(sources.in_memory(spark, files.items()))
        written.pop()
        queries = {0: "memory the", 1: "kiln", 2: "ston", 3: "doc"}
        asked = {"limit": 50, "fuzzy": 0.2}
        for prune in (10**9, 0):
            monkeypatch.setattr(searching, "PRUNE_FROM", prune)
            rows = lambda h: sorted((r.query_id, r.rank, r.section_id, r.score) for r in h.search_many(queries, asked).collect())
            assert rows(handle) == rows(fresh)
        assert handle.index_stats()["documents"] == fresh.index_stats()["documents"]
        stat = lambda h: sorted((r.field, r.n_docs, round(r.avg_dl, 9)) for r in h._index.field_stats.collect())
        assert stat(handle) == stat(fresh)

    def ingest(part):
        files.update(part)
        handle.ingest_many(sources.in_memory(spark, part.items()))

    ingest({f"d{i}.md": concept(f"Doc {i}", text(i, 2)) for i in range(0, 12, 2)} | {"n0.md": concept("New", "memory of the kiln")})
    assert written == [7] and [(s.n_documents, s.n_gone) for s in handle._segments] == [(30, 6), (7, 0)]
    check()
    ingest({f"d{i}.md": concept(f"Doc {i}", text(i, 3)) for i in range(4)} | {"m.md": concept("M", "stone")})
    assert written[1:] == [5] and [(s.n_documents, s.n_gone) for s in handle._segments][:2] == [(30, 8), (7, 2)]
    handle.remove_many(["d5.md", "n0.md"])  # a small change beside the segments
    handle.ingest("d6.md", concept("Doc 6", "lichen and kiln"))
    del files["d5.md"], files["n0.md"]
    files["d6.md"] = concept("Doc 6", "lichen and kiln")
    check()
    before = len(written)
    ingest({f"k{i}.md": concept(f"K {i}", text(i, 4)) for i in range(5)})  # the small changes, the new documents; then a size class is full
    assert 30 not in written[before:] and max(written) < 30 and len(handle._segments) <= 3
    check()
    handle.merge()
    check()


def test_folders_are_listed_by_level_and_by_other_file_systems(spark, tmp_path):
    for name in ("a.md", "x/b.md", "x/y/z/c.md", "x/y/log.md", "x/index.md", "q/.h/d.md", "x/e.txt"):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(concept(name, "body"))
    os.symlink(tmp_path / "in/x", tmp_path / "in/linked")
    names = {"a.md", "x/b.md", "x/y/z/c.md", "q/.h/d.md"}
    for root in (f"{tmp_path}/in", f"file://{tmp_path}/in", f"file:{tmp_path}/in/"):
        assert {r.path for r in sources.directory(spark, root).collect()} == names
    plan = sources.discover(spark, f"{tmp_path}/in")
    assert {(r.path, r.kind) for r in plan.collect()} == {(n, "document") for n in names}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}/in")
    rows = {r.path: r.markdown for r in sources.directory(spark, "viewfs://far/in").collect()}
    assert {n for n in rows if "linked" not in n} == names - {"q/.h/d.md"} and rows["x/b.md"] == concept("x/b.md", "body")
    with pytest.raises(ConceptError) as e:
        sources.directory(spark, f"{tmp_path}/nowhere")
    assert (e.value.code, e.value.path) == ("ERR_READ", f"{tmp_path}/nowhere")


def test_counts_come_from_signed_changes_alone(spark, monkeypatch):
    from lorebase import handle as module
    from lorebase.operators import stats

    monkeypatch.setattr(module, "MERGE_AFTER", 4)
    draw = random.Random(7)
    kinds, statuses = ["Kiln", "Glaze", "Ä"], ["draft", "stable", "deprecated", "odd", None]
    one = lambda: f"---\ntype: {draw.choice(kinds)}\ntitle: t\n" + (f"status: {s}\n" if (s := draw.choice(statuses)) else "") + "---\nclay\n"
    handle = create_search(sources.in_memory(spark, [(f"d{i}.md", one()) for i in range(8)]))

    def check():
        documents = handle.documents
        want = {"documents": stats.totals(documents).first().asDict(), "types": [r.asDict() for r in stats.types(documents).collect()], "statuses": stats.statuses(documents).first().asDict(), "trust_tiers": stats.trust_tiers(documents).first().asDict()}
        assert handle.index_stats() == want and handle.list_types() == [t["type"] for t in want["types"]]
        assert not set(handle._index.inventory.inputFiles()) & set(documents.inputFiles())

    for step in range(6):
        for _ in range(draw.randint(1, 2)):
            name = f"d{draw.randrange(11)}.md"
            handle.remove(name) if draw.random() < 0.4 else handle.ingest(name, one())
        if step % 3 == 2:
            handle.ingest_many(sources.in_memory(spark, [(f"d{draw.randrange(6)}.md", one())] + [(f"m{step}-{i}.md", one()) for i in range(5)]))
        check()
    handle.remove_many([r.path for r in handle.documents.collect()])
    check()
    assert handle.index_stats()["documents"]["total"] == 0 and titles(handle, "clay") == []


def test_only_one_of_many_claims_a_name(spark, tmp_path):
    won, places = [], [store.Place(spark, f"{tmp_path}/c/{1:020}") for _ in range(12)]
    threads = [threading.Thread(target=lambda i=i, p=p: won.append((p.claim(f"of {i}"), i))) for i, p in enumerate(places)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    (winner,) = [i for good, i in won if good]
    assert len(won) == 12 and places[0].read() == f"of {winner}" and [n for n in os.listdir(tmp_path / "c") if not n.endswith(".crc")] == [f"{1:020}"]


def test_two_writers_keep_each_others_changes(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    create_search(sources.in_memory(spark, FILES.items())).save(cache)
    first, second, reader = (open_concepts(spark, "/nowhere", cache) for _ in range(3))
    first.ingest("a.md", concept("Ash", "ash of the kiln"))
    first.remove("half.md")
    second.ingest("b.md", concept("Bole", "bole of the kiln"))
    second.ingest("memory/search.md", concept("Search again", "a kiln searched"))

    met, real, waited = threading.Barrier(2), store._written, set()

    def written(index, folder):
        out = real(index, folder)
        if threading.get_ident() not in waited:  # both have written before either commits
            waited.add(threading.get_ident())
            met.wait(120)
        return out

    monkeypatch.setattr(store, "_written", written)
    failed = []

    def run(handle):
        try:
            handle.save(cache)
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(h,)) for h in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert failed == []
    monkeypatch.setattr(store, "_written", real)
    want = {".hidden/_kiln.md": "Kiln", "a.md": "Ash", "b.md": "Bole", "memory/search.md": "Search again"}
    found = open_concepts(spark, "/nowhere", cache)
    assert {r.path: r.title for r in found.documents.collect()} == want and sorted(titles(found, "kiln")) == sorted(want.values())
    fresh = create_search(sources.in_memory(spark, [(".hidden/_kiln.md", FILES[".hidden/_kiln.md"]), ("a.md", concept("Ash", "ash of the kiln")), ("b.md", concept("Bole", "bole of the kiln")), ("memory/search.md", concept("Search again", "a kiln searched"))]))
    scored = lambda h: [(r.section_id, r.score) for r in h.search("kiln searched bole").collect()]
    assert scored(found) == scored(fresh) and found.index_stats() == fresh.index_stats()

    # the one that came second has both; the other gets the rest when it saves again, and its next change alone counts
    late = max((first, second), key=lambda h: h.documents.count())
    early = first if late is second else second
    assert {r.path for r in late.documents.collect()} == set(want)
    late.remove("a.md")
    late.save(cache)
    early.ingest("c.md", concept("Clay", "clay"))
    early.save(cache)
    for h in (early, open_concepts(spark, "/nowhere", cache)):
        assert {r.path for r in h.documents.collect()} == set(want) - {"a.md"} | {"c.md"}

    # tables that are not sound together are refused, and nothing is committed
    before = store.newest(store.Place(spark, cache))
    early.ingest("d.md", concept("Dung", "dung"))
    late.save(cache)

    def refuse(*_):
        raise ConceptError("ERR_FIELD", "d#x", "repeated section_id")

    with monkeypatch.context() as patch, pytest.raises(ConceptError) as e:
        patch.setattr("lorebase.handle._sound", refuse)
        early.save(cache)
    assert (e.value.code, e.value.path, store.newest(store.Place(spark, cache))[0]) == ("ERR_FIELD", "d#x", before[0] + 1)

    # readers of the first generation go on until it is vacuumed
    assert store.vacuum(spark, cache) == [] and sorted(titles(reader, "memory")) == ["Half", "Memory search"]
    assert len(store.vacuum(spark, cache, 0)) == 5 and [p for p in os.listdir(cache) if p.startswith("gen-")] == [store.newest(store.Place(spark, cache))[1]]
    assert "Clay" in titles(open_concepts(spark, "/nowhere", cache), "clay")
    os.mkdir(f"{cache}/gen-left")  # of a writer that is gone
    assert store.vacuum(spark, cache) == [] and store.vacuum(spark, cache, 0) == ["gen-left"]
