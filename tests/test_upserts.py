import pytest
from lorebase.handle import create_search
from lorebase.sources import documents as sources
from lorebase.streaming import upserts

ROW = "path string, markdown string, version long"


def concept(title):
    return f"---\ntype: Guide\ntitle: {title}\n---\nkiln {title}\n"


def titles(handle):
    return {r.path: r.title for r in handle.documents.select("path", "title").collect()}


@pytest.fixture
def opened(spark, tmp_path):
    base = sources.in_memory(spark, [("base.md", concept("Base"))])
    return lambda: create_search(base), upserts.Journal(spark, str(tmp_path / "journal"))


def give(spark, handle, journal, number, *rows):
    upserts.upsert(handle, spark.createDataFrame(list(rows), ROW).repartition(2), journal, number)
    return {r.path: r.outcome for r in journal.outcomes().where(f"batch = {number}").collect()}


def test_versions_hold_across_batches_and_removals_keep_theirs(spark, opened):
    make, journal = opened
    handle = make()
    assert give(spark, handle, journal, 0, ("a.md", concept("Nine"), 9), ("./a.md", concept("Eight"), 8), ("b.md", concept("B"), 1)) == {"a.md": "strict", "b.md": "strict"}
    assert give(spark, handle, journal, 1, ("a.md", concept("Three"), 3), ("b.md", None, 5)) == {"a.md": "stale", "b.md": "removed"}
    assert give(spark, handle, journal, 2, ("b.md", concept("B four"), 4), ("c.md", None, 1), ("a.md", None, 9)) == {"b.md": "stale", "c.md": "absent", "a.md": "stale"}
    assert titles(handle) == {"base.md": "Base", "a.md": "Nine"}
    assert give(spark, handle, journal, 3, ("b.md", concept("B six"), 6), ("b.md", None, 6), ("c.md", concept("C"), None)) == {"b.md": "absent", "c.md": "stale"}
    assert give(spark, handle, journal, 4, ("b.md", concept("B seven"), 7)) == {"b.md": "strict"}
    assert titles(handle)["b.md"] == "B seven"


def test_bad_rows_have_outcomes_and_stop_nothing(spark, opened):
    make, journal = opened
    handle = make()
    told = give(spark, handle, journal, 0, ("../bad.md", None, 1), (None, concept("N"), 1), ("f.md", "no envelope", 1), ("d.md", "---\ntype: A\nstatus: odd\n---\n", 1), ("g.md", concept("Good"), 1), ("x.txt", None, 2))
    assert told == {"<input>": "rejected", "f.md": "fatal", "d.md": "degraded", "g.md": "strict", "x.txt": "rejected"}
    assert set(titles(handle)) == {"base.md", "d.md", "g.md"}


def test_a_batch_that_is_run_again_changes_nothing(spark, opened):
    make, journal = opened
    handle = make()
    rows = [("a.md", concept("One"), 1), ("base.md", None, 2)]
    first = give(spark, handle, journal, 0, *rows)
    again = give(spark, handle, journal, 0, *rows)
    assert first == {"a.md": "strict", "base.md": "removed"} and again == {"a.md": "strict", "base.md": "absent"} and titles(handle) == {"a.md": "One"}
    assert sorted(r.version for r in journal.rows().collect()) == [1, 2]


def test_a_new_handle_after_a_restart_has_all_documents(spark, opened, tmp_path, monkeypatch):
    make, _ = opened
    monkeypatch.setattr(upserts, "FOLD", 2)
    at, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    feed = lambda *rows: spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(at)
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(at)
    for i in range(4):
        feed((f"n{i}.md", concept(f"N{i}"), 1), ("a.md", concept(f"A{9 - i}"), 9 - i))
    first = make()
    upserts.start(first, stream(), progress).awaitTermination(120)
    assert titles(first) == {"base.md": "Base", "a.md": "A9", **{f"n{i}.md": f"N{i}" for i in range(4)}}
    feed(("n0.md", None, 2), ("a.md", concept("A5"), 5), ("last.md", concept("Last"), 1))
    second = make()  # the first one is lost
    upserts.start(second, stream(), progress).awaitTermination(120)
    assert titles(second) == {"base.md": "Base", "a.md": "A9", "last.md": "Last", **{f"n{i}.md": f"N{i}" for i in range(1, 4)}}
    journal = upserts.Journal(spark, f"{progress}/upserts")
    assert journal._ids("fold") and len(journal._ids("batch")) <= 3
    assert {(r.batch, r.outcome) for r in journal.outcomes().where("path = 'a.md'").collect()} == {(0, "strict"), (1, "stale"), (2, "stale"), (3, "stale"), (4, "stale")}
    assert {r.title for r in second.search("kiln", {"limit": 50}).collect()} == {"Base", "A9", "Last", "N1", "N2", "N3"}
