"""The search handle: open, search, suggest, ingest, remove, statistics, save."""

from __future__ import annotations

import threading
import time
from collections import Counter
from concurrent.futures import Future
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .errors import ConceptError
from .functions import paths
from .operators import index as indexing
from .operators import prepare as preparing
from .operators import search as searching
from .operators import stats
from .operators.index import Index
from .operators.segments import Segment, changed, combined, made, segmented
from .operators.suggest import suggest
from .plans.options import among, validate
from .sources import documents as sources
from .sources import shared, store

DOCUMENT = indexing.DOCUMENT + f", diagnostics array<{preparing.DIAGNOSTIC}>"
#: Changed documents that are held beside the segments before they become one.
MERGE_AFTER = 1000


@dataclass
class Since:
    """A generation that a handle was read from or saved as, and (document_id) of what it changed since: ids and frames of them."""

    generation: str
    ids: set[str] = field(default_factory=set)
    frames: list[DataFrame] = field(default_factory=list)


class ConceptSearch:
    """A mutable view over immutable tables: segments, removed identities and a small set of new documents.

    Every answer is a DataFrame or plain values; none aliases the handle's state. A failure while a change is applied
    poisons the handle; errors of options, queries and preparation do not. open_concepts(), create_search() and
    from_prepared() store the tables first, in the shared folder, so that searches look up what is there. Changes beyond
    MERGE_AFTER documents become a segment of their own; what is stored is not rewritten but by merges of TIER segments.

    Any number of handles, in any number of applications, may save to one path. A handle that was read from there or saved
    there brings its own changes to what others have saved since, and then has theirs too; of two changes of one document
    the one that is saved last counts. A handle that has nothing to do with the path takes the place of what is there.
    """

    def __init__(self, index: Index):
        self._spark: SparkSession = index.documents.sparkSession
        self._segments: list[Segment] = []  # known once there is a second one
        self._base, self._index = index, index
        self._gone: set[str] = set()
        self._new: dict[str, tuple[dict, list[dict]]] = {}
        self._lost: dict[str, tuple] = {}  # what the removed documents of the base count in its inventory
        self._failed: str | None = None
        self._saved: dict[str, Since] = {}
        self._lock = threading.RLock()

    def _usable(self) -> None:
        if self._failed is not None:
            raise ConceptError("ERR_INDEX_UNUSABLE", self._failed)

    # queries

    @property
    def documents(self) -> DataFrame:
        """One row for each document."""
        self._usable()
        return self._index.documents

    @property
    def sections(self) -> DataFrame:
        """One row for each section."""
        self._usable()
        return self._index.sections

    def search(self, query: str, options: dict | None = None) -> DataFrame:
        """Ranked hits, best first."""
        self._usable()
        checked = validate(query, options)
        return searching.search_many(self._index, {0: query}, checked).orderBy("rank").drop("query_id", "rank")

    def search_many(self, queries: dict[int, str], options: dict | None = None) -> DataFrame:
        """Hits of many queries in one plan, with query_id and rank."""
        self._usable()
        checked = [validate(q, options) for q in queries.values()] or [validate("", options)]
        return searching.search_many(self._index, queries, checked[0])

    def suggest(self, query: str, options: dict | None = None) -> DataFrame:
        """Completions, best first."""
        self._usable()
        return suggest(self._index, query, validate(query, options, suggest=True))

    # inventory

    def _counts(self) -> dict:
        self._usable()
        return stats.summary(self._index.inventory.collect())  # a row for each type, and some ten

    def index_stats(self, path: str | None = None) -> dict:
        """Counts over documents; with the path of a saved index, its bytes."""
        self._usable()
        return self._counts() | ({"storage": {"kind": "parquet-index-files", "size_in_bytes": store.size_in_bytes(self._spark, path)}} if path else {})

    def list_types(self) -> list[str]:
        """The document types, sorted."""
        return [t["type"] for t in self._counts()["types"]]

    def list_degraded(self) -> list[dict]:
        """Documents with diagnostics, by path."""
        return [r.asDict(recursive=True) for r in stats.degraded(self.documents).collect()]

    # changes

    def _rows(self, rows: list[dict], schema: str) -> DataFrame:
        """Few rows as a part of the plan itself."""
        kind = StructType.fromDDL(schema)
        return self._spark.createDataFrame(pa.Table.from_pylist([{f.name: r.get(f.name) for f in kind.fields} for r in rows], to_arrow_schema(kind)), kind)

    def _conflict(self, made: list[dict]) -> dict[str, tuple]:
        """Raises ERR_FIELD if a new document's path or section is another document's; what it replaces, as of _counted()."""
        owners = {one["document_id"]: one["path"] for one in made}
        owned = {s["section_id"]: one["document_id"] for one in made for s in one["sections"]}
        placed = self._index.documents.where(among("document_id", list(owners)) | among("path", list(owners.values()))).select("document_id", "path", *stats.KINDS).collect()
        for r in placed:  # two rows for each new document at most
            if owners.get(r.document_id, r.path) != r.path or (r.path in owners.values() and r.document_id not in owners):
                raise ConceptError("ERR_FIELD", r.path, "path")
        for r in self._index.sections.where(among("section_id", list(owned))).select("section_id", "document_id").collect():
            if r.document_id != owned[r.section_id]:
                raise ConceptError("ERR_FIELD", owners[owned[r.section_id]], "sections")
        return self._counted(r for r in placed if r.document_id in owners)

    def _counted(self, rows) -> dict[str, tuple]:
        """The values of KINDS of those of these documents that the base holds, by their ids."""
        return {r.document_id: tuple(r[k] for k in stats.KINDS) for r in rows if r.document_id not in self._gone and r.document_id not in self._new}

    def _inventory(self, lost: dict[str, tuple], new: dict) -> DataFrame:
        """The base's inventory with the changes beside it, as literals."""
        change = Counter()
        for values in lost.values():
            change.subtract(zip(stats.KINDS, values, strict=True))
        for d, _ in new.values():
            change.update((k, d[k]) for k in stats.KINDS)
        return stats.added(self._base.inventory.unionByName(self._rows([{"kind": k, "value": v, "n": n} for (k, v), n in change.items() if n], stats.INVENTORY)))

    def _apply(self, path: str, gone: set[str], new: dict, changed: set[str], lost: dict[str, tuple]) -> None:
        try:
            names = self._base.documents.columns
            documents = self._rows([d for d, _ in new.values()], DOCUMENT).select(names)
            sections = self._rows([s for _, rows in new.values() for s in rows], indexing.SECTION)
            lost = self._lost | lost
            index = replace(indexing.patched(self._base, sorted(gone), documents, sections), inventory=self._inventory(lost, new)) if gone or new else self._base
            # what is there now must be what the changes say, before anything is answered from it
            found = index.sections.where(among("document_id", sorted(changed))).groupBy("document_id").count().collect()
            if {r[0]: r[1] for r in found} != {i: len(new[i][1]) for i in changed if i in new}:
                raise RuntimeError("the sections of a changed document are not those that it was given")
        except Exception as e:
            self._failed = path
            raise ConceptError("ERR_INDEX_UNUSABLE", path) from e
        self._index, self._gone, self._new, self._lost = index, gone, new, lost
        for saved in self._saved.values():
            saved.ids |= changed
        if len(gone) + len(new) > MERGE_AFTER:
            self._flush()

    def _flush(self, documents: DataFrame | None = None, sections: DataFrame | None = None) -> None:
        """Makes a segment of the changes beside the base, then of these documents, which stand for those of their ids."""
        with self._lock:
            self._usable()
            try:
                segments = self._segments or [segmented(self._base)]
                if self._gone or self._new:
                    names = self._base.documents.columns
                    new = made(self._rows([d for d, _ in self._new.values()], DOCUMENT).select(names), self._rows([s for _, rows in self._new.values() for s in rows], indexing.SECTION)) if self._new else None
                    segments = changed(segments, self._rows([{"document_id": i} for i in sorted(self._gone)], "document_id string"), new)
                if documents is not None:
                    new = made(documents.select(self._base.documents.columns), sections)
                    segments = changed(segments, new.index.documents.select("document_id"), new)
                    for saved in self._saved.values():
                        saved.frames.append(new.index.documents.select("document_id"))
                self._segments = segments
                self._base = self._index = combined(segments)
                self._gone, self._new, self._lost = set(), {}, {}
            except Exception as e:
                self._failed = "<index>"
                raise ConceptError("ERR_INDEX_UNUSABLE", "<index>") from e

    def merge(self) -> None:
        """Stores all segments and changes as one new base in the shared folder."""
        with self._lock:
            self._usable()
            try:
                self._base = self._index = store.stored(self._index)
                self._segments, self._gone, self._new, self._lost = [], set(), {}, {}
            except Exception as e:
                self._failed = "<index>"
                raise ConceptError("ERR_INDEX_UNUSABLE", "<index>") from e

    def ingest(self, path: str, markdown: str) -> dict:
        """Adds or replaces one document; its typed fields if strict, its diagnostics if degraded."""
        return self._ingest([(path, markdown)])[0]

    def _ingest(self, rows: list[tuple[str, str]]) -> list[dict]:
        self._usable()
        made = []
        for path, markdown in rows:
            one = preparing.prepare_one(paths.normalize(path), markdown)
            if one["outcome"] == "fatal":
                d = one["diagnostics"][0]
                raise ConceptError(d["code"], one["path"], d["field"])
            made.append(one)
        self._add(made)
        return [_view(one) for one in made]

    def _add(self, made: list[dict]) -> None:
        with self._lock:
            lost = self._conflict(made)
            gone, new = set(self._gone), dict(self._new)
            for one in made:
                identity = one["document_id"]
                gone.add(identity)
                new[identity] = ({k: one.get(k) for k in DOCUMENT_COLUMNS}, [s | {"document_id": identity} for s in one["sections"]])
            self._apply(made[-1]["path"], gone, new, {one["document_id"] for one in made}, lost)

    def ingest_many(self, documents: DataFrame) -> DataFrame:
        """Adds or replaces every good row of (path, markdown); (path, outcome, errors) of all rows.

        outcome is strict, degraded, rejected (its path) or fatal. Of rows with one identity the last counts: that of the
        greatest ``version`` if there is such a column, else the last in the order of the frame. Up to MERGE_AFTER
        documents become changes beside the base, more a segment of their own.
        """
        self._usable()
        version = F.col("version") if "version" in documents.columns else F.monotonically_increasing_id()
        rows = shared.cut(documents.select(paths.normalized(F.col("path")).alias("n"), "markdown", version.alias("version")).select("n.path", "markdown", "version", "n.error_path"))
        bad = rows.where("error_path is not null").select(F.col("error_path").alias("path"), F.lit("rejected").alias("outcome"), F.lit(None).cast(f"array<{preparing.DIAGNOSTIC}>").alias("errors"))
        good = rows.where("error_path is null").groupBy("path").agg(F.max_by("markdown", "version").alias("markdown"))
        prepared = shared.cut(preparing.prepare(good))
        accepted = prepared.where("outcome = 'accepted'")
        n = accepted.count()
        if n and n <= MERGE_AFTER:
            self._add([r.asDict(recursive=True) for r in accepted.select(*DOCUMENT_COLUMNS, "sections").collect()])
        elif n:
            self._flush(*preparing.split(prepared))
        outcome = prepared.select("path", F.coalesce("conformance", F.lit("fatal")).alias("outcome"), F.col("diagnostics").alias("errors"))
        return outcome.unionByName(bad)

    def remove(self, path: str) -> bool:
        """Whether a document was there to be removed."""
        return bool(self.remove_many([path]))

    def remove_many(self, given: list[str]) -> list[str]:
        """Removes the documents of these paths at once; the normalised paths of those that were there."""
        self._usable()
        kept = {paths.document_id(p): p for p in map(paths.normalize, given)}
        with self._lock:
            found = self._index.documents.where(among("document_id", list(kept))).select("document_id", *stats.KINDS).collect() if kept else []
            there = {r.document_id for r in found}
            if there:
                self._apply(kept[min(there)], self._gone | there, {k: v for k, v in self._new.items() if k not in there}, there, self._counted(found))
        return sorted(kept[i] for i in there)

    def save(self, path: str) -> None:
        """The index as it is now, with what others have saved at path since this handle was read from there or saved there."""
        with self._lock:
            self._usable()
            key, moved = store.Place(self._spark, path).url, []
            since = self._saved.get(key)
            generation, index = store.save(self._index, path, since and since.generation, since and (lambda newest: moved.append(1) or self._rebased(newest, since)))
            if moved:
                self._base = self._index = index
                self._segments, self._gone, self._new, self._lost = [], set(), {}, {}
                for other in self._saved.values():
                    other.frames.append(index.documents.select("document_id"))
            self._saved[key] = Since(generation)

    def _rebased(self, newest: Index, since: Since) -> Index:
        """The newest index with this handle's changes since another; raises ERR_FIELD if both cannot be."""
        ids = self._rows([{"document_id": i} for i in sorted(since.ids)], "document_id string")
        for more in since.frames:
            ids = ids.unionByName(more)
        ids = shared.cut(ids.distinct())
        own = lambda frame: shared.cut(frame.join(ids, "document_id", "left_semi").select(frame.columns))
        documents, sections = own(self._index.documents), own(self._index.sections)
        new = None if documents.isEmpty() else made(documents.select(newest.documents.columns), sections)
        index = combined(changed([segmented(newest)], ids, new))
        _sound(index.documents, index.sections)
        return index


DOCUMENT_COLUMNS = ("document_id", "path", "type", "title", "tags", "status", "trust_tier", "stale_after_epoch", "staleness_classified", "conformance", "resource", "description", "source_text", "diagnostics")


def _view(one: dict) -> dict:
    if one["conformance"] == "degraded":
        return {k: one[k] for k in ("document_id", "path", "diagnostics")}
    return {k: v for k, v in one.items() if k not in ("outcome", "sections", "diagnostics", "source_text")}


def _sound(documents: DataFrame, sections: DataFrame) -> None:
    wrong = indexing.violations(documents, sections).orderBy("key", "rule").limit(1).collect()
    if wrong:
        raise ConceptError("ERR_FIELD", wrong[0].key or "<input>", wrong[0].rule)


def from_prepared(documents: DataFrame, sections: DataFrame) -> ConceptSearch:
    """A handle over prepared tables, which are validated; the first violation is raised as ERR_FIELD."""
    _sound(documents, sections)
    return ConceptSearch(store.stored(indexing.build(documents, sections), rebuild=True))


def create_search(raw: DataFrame) -> ConceptSearch:
    """A handle over rows of (path, markdown); raises the first failure in path order."""
    rows = preparing.normalized(raw)
    prepared = shared.cut(preparing.prepare(rows.where("error_path is null")))
    failure = preparing.first_failure(rows, prepared)
    if failure:
        raise failure
    return ConceptSearch(store.stored(indexing.build(*preparing.split(prepared)), rebuild=True))


def open_concepts(spark: SparkSession, root: str, cache_path: str | None = None) -> ConceptSearch:
    """A handle over a folder of concepts; a cache that exists is used instead of the folder, one that doesn't is made."""
    if cache_path and store.exists(spark, cache_path):
        generation, index = store.loaded(spark, cache_path)
        found = ConceptSearch(index)
        found._saved[store.Place(spark, cache_path).url] = Since(generation)
        return found
    found = create_search(sources.directory(spark, root))
    if cache_path:
        found.save(cache_path)
    return found


class Snapshots:
    """A handle that is built once, on first use, and replaced by refresh(); a failed refresh keeps the old one.

    Callers that come while a handle is built wait for that one build; each can give up waiting by its own timeout
    (TimeoutError), which neither stops the build nor the others.
    """

    def __init__(self, build, root: str | None = None):
        self._build, self._root = build, root
        self._lock, self._ready, self._at, self._building = threading.Lock(), None, 0.0, None

    def _made(self, timeout: float | None) -> ConceptSearch:
        with self._lock:
            running = self._building
            if running is None:
                running = self._building = Future()
                threading.Thread(target=self._run, args=(running,), daemon=True).start()
        return running.result(timeout)

    def _run(self, running: Future) -> None:
        try:
            made, failure = self._build(), None
        except BaseException as e:
            made, failure = None, e
        with self._lock:
            self._building = None
            if failure is None:
                self._ready, self._at = made, time.time()
        if failure is None:
            running.set_result(made)
        else:
            running.set_exception(failure)

    def get(self, timeout: float | None = None) -> ConceptSearch:
        """The current handle, built if there is none."""
        return self._ready or self._made(timeout)

    def refresh(self, timeout: float | None = None) -> ConceptSearch:
        """A new handle in place of the old; one build serves all who ask while it runs."""
        return self._made(timeout)

    def status(self) -> dict:
        """Root, types, degraded documents and age in seconds of the current handle."""
        counts = self.get()._counts()
        return {"root": self._root, "types": [t["type"] for t in counts["types"]], "degraded": counts["documents"]["degraded"], "age_seconds": time.time() - self._at}
