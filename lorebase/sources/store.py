"""Stored indexes: Parquet tables sorted for lookups, and saved generations of them with a checked manifest.

A cache is a folder of generations and of numbered commits, each of which names a generation; the greatest number is in
force. A generation is complete before its commit, and a commit is made under the next number only if there is none, so
of writers that meet one succeeds. The others bring their changes to what is there now and try the next number; no lock
is held, and a failed save leaves the cache as it is. What a commit replaces stays for its readers for RETAIN seconds.
That a commit is made once rests on links of local files and on renames elsewhere that refuse a name that is taken.

All files are reached through Hadoop's file systems, so a cache can be anywhere that Spark writes. Executors digest the
content of files in ranges of rows, which fold to one digest for each file; the ranges are kept, so damage can be placed.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ConceptError
from ..operators import index as indexing
from ..operators import stats
from ..operators.index import TABLES, Index
from . import shared

#: What a reader must agree on: layout, analysis and preparation revisions.
REVISIONS = {"format": 4, "analysis": 1, "preparation": 1}
#: Numbers that a writer tries, and the folder of commits.
ATTEMPTS = 20
COMMITS = "commits"
#: Seconds for which a generation stays after another took its place, and which the writing of one may take.
RETAIN = 24 * 3600
MOST_MANIFEST = 1 << 26
#: The columns that each table must have.
SCHEMAS = {
    "documents": indexing.DOCUMENT, "sections": indexing.SECTION, "blocks": indexing.BLOCKS,
    "term_stats": "field string, term string, df long", "field_stats": "field string, n_docs long, avg_dl double", "variants": "variant string, stem string, term string", "inventory": stats.INVENTORY,
}
#: Rows of a range of a file that has a digest of its own, and the folder of these.
LEAF = 1 << 16
LEAVES = "leaves"


class Place:
    """A path in any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.text = spark, path
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else os.path.abspath(path) if not path.startswith("/") else path)
        self._fs = at.getFileSystem(self._conf)
        self._at = self._fs.makeQualified(at)
        self.url = self._at.toString()

    def of(self, name: str) -> Place:
        return Place(self.spark, f"{self.url.rstrip('/')}/{name}")

    def sibling(self, name: str) -> Place:
        return Place(self.spark, self._jvm.org.apache.hadoop.fs.Path(self._at.getParent(), name).toString())

    @property
    def name(self) -> str:
        return self._at.getName()

    @property
    def local(self) -> str | None:
        """The path in the local file system; None in others."""
        return re.sub("^file:/+", "/", self._at.toUri().getScheme() + ":" + self._at.toUri().getPath()) if self.url.startswith("file:") else None

    def linked(self) -> bool:
        """Whether this is a link of the local file system."""
        return self.local is not None and os.path.islink(self.local)

    def exists(self) -> bool:
        return self._fs.exists(self._at) or self.linked()

    def is_folder(self) -> bool:
        return self._fs.exists(self._at) and self._fs.getFileStatus(self._at).isDirectory()

    def age(self) -> float:
        return time.time() - self._fs.getFileStatus(self._at).getModificationTime() / 1000

    def delete(self) -> None:
        self._fs.delete(self._at, True)

    def read(self, most: int = MOST_MANIFEST) -> str:
        """The text of a small file; OSError if there is none or it is larger."""
        try:
            if self._fs.getFileStatus(self._at).getLen() > most:
                raise OSError(f"{self.text} is too large")
            stream = self._fs.open(self._at)
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(self.text) from e

    def names(self) -> list[str]:
        """What a folder holds, sorted; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at)) if self.is_folder() else []

    def write(self, text: str) -> None:
        """The file anew."""
        try:
            stream = self._fs.create(self._at, True)
            try:
                stream.write(bytearray(text.encode()))
                stream.hflush()
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(self.text) from e

    def claim(self, text: str) -> bool:
        """Makes the file, whole from its first moment; False if there is one. Of many that claim it one succeeds."""
        draft = self.sibling(f".{self.name}-{uuid.uuid4().hex}")
        draft.write(text)
        try:
            if self.local is not None:
                os.link(draft.local, self.local)
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self._conf).rename(draft._at, self._at, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if self.exists():
                return False
            raise OSError(self.text) from e
        finally:
            draft.delete()


def _write(frame: DataFrame, table: str, folder: str, rows: int = 0) -> DataFrame:
    """frame as a stored table, read again; rows: about how many it has, if it has far more than the documents have sections."""
    keys = indexing.SORTED.get(table)
    if keys:
        # a range of keys to a file, so that a lookup reads few files and row groups
        frame = indexing.ranged(frame, rows, *keys)
    frame.write.parquet(f"{folder}/{table}", compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{table}")


def stored(index: Index, folder: str | None = None, rebuild: bool = False, fuzzy: bool = True) -> Index:
    """index as tables of a folder, by default one of the shared folder; postings as blocks, statistics from these.

    With rebuild the postings are those of the stored documents and sections, so these are worked out once. Without fuzzy
    the neighbourhoods are not stored, which are the largest table: fuzzy terms have them worked out when they are asked.
    """
    spark = index.documents.sparkSession
    folder = folder or shared.folder(spark)
    documents, sections = _write(index.documents, "documents", folder), _write(index.sections, "sections", folder)
    blocks, field_stats = _blocked(indexing.build(documents, sections).postings if rebuild else index.postings, sections, folder)
    term_stats = _write(blocks.groupBy("field", "term").agg(F.sum("n").alias("df")), "term_stats", folder)
    if fuzzy:
        stems = shared.cut(indexing.stems(term_stats))  # counted, and ranges are drawn in a pass of its own
        variants = _write(indexing.around(stems), "variants", folder, stems.count() * indexing.VARIANTS)
    else:
        variants = indexing.neighbourhoods(term_stats)
    inventory = _write(stats.inventory(documents), "inventory", folder)
    return opened(documents=documents, sections=sections, blocks=blocks, term_stats=term_stats, field_stats=field_stats, variants=variants, inventory=inventory)


def _blocked(postings: DataFrame, sections: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of postings and the field statistics, as tables of a folder."""
    source = shared.cut(postings)  # ranges are drawn in a pass of its own
    field_stats = _write(counted(source, sections), "field_stats", folder)
    return _write(indexing.blocked(source, {r.field: r.avg_dl for r in field_stats.collect()}), "blocks", folder), field_stats


def blocks(index: Index) -> DataFrame:
    """The postings of index as blocks of the shared folder, without its other tables."""
    return _blocked(index.postings, index.sections, shared.folder(index.documents.sparkSession))[0]


def opened(blocks: DataFrame, **tables: DataFrame) -> Index:
    """An index of stored tables."""
    return Index(**tables, postings=indexing.decoded(blocks), parts=(indexing.Part(blocks),))


def counted(postings: DataFrame, sections: DataFrame) -> DataFrame:
    """The field statistics that postings and sections add up to."""
    every = sections.agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 0").select("n_docs", F.explode(F.array(*map(F.lit, indexing.FIELDS))).alias("field"))
    totals = postings.groupBy("field").agg(F.sum("tf").alias("total"))
    return every.join(totals, "field", "left").select("field", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avg_dl"))


def _lengths(place: Place) -> dict[str, int]:
    """The length of each Parquet file below a folder by its path from there."""
    found, every, root = {}, place._fs.listFiles(place._at, True), re.sub("^file:/+", "file:/", place.url).rstrip("/") + "/"
    while every.hasNext():
        one = every.next()
        if one.getPath().getName().endswith(".parquet"):
            found[re.sub("^file:/+", "file:/", one.getPath().toString()).removeprefix(root)] = one.getLen()
    return found


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    """(file, part, rows, digest): the content of each range of LEAF rows of each file of a generation.

    Executors hash every row with its place in its file, under two seeds, and combine the hashes in partial sums, so
    neither a file nor a range is ever held as a whole, and files may be of any length.
    """
    out = None
    for table in TABLES:
        rows = spark.read.parquet(f"{folder}/{table}")
        at, columns = F.col("_metadata.row_index"), [F.col(c) for c in rows.columns]
        hashed = rows.select(F.concat(F.lit(f"{table}/"), F.col("_metadata.file_name")).alias("file"), F.floor(at / LEAF).cast("long").alias("part"), F.xxhash64(F.lit(1), at, *columns).alias("a"), F.xxhash64(F.lit(2), at, *columns).alias("b"))
        found = hashed.groupBy("file", "part").agg(F.count(F.lit(1)).alias("rows"), F.concat(F.hex(F.bit_xor("a")), F.hex(F.bit_xor("b"))).alias("digest"))
        out = found if out is None else out.unionByName(found)
    return out


def _digests(spark: SparkSession, folder: str, found: DataFrame | None = None) -> dict[str, list]:
    """(length, digest) of each Parquet file of a generation: its leaves, folded by SHA-256; found: the leaves, if they were just worked out."""
    folded = (leaves(spark, folder) if found is None else found).groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rows", "digest"))), lambda x: F.concat_ws(":", x["part"].cast("string"), x["rows"].cast("string"), x["digest"])), ","), 256).alias("digest"))
    held = {r.file: r.digest for r in folded.collect()}  # one row for each file
    return {name: [length, held.get(name, "")] for name, length in sorted(_lengths(Place(spark, folder)).items()) if not name.startswith(LEAVES)}


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_row, last_row) of the ranges of the current generation whose content is not what was saved."""
    folder = _manifest(spark, path)[1]
    now, then = leaves(spark, folder), spark.read.parquet(f"{folder}/{LEAVES}")
    wrong = now.unionByName(then).groupBy("file", "part").agg(F.count_distinct(F.struct("rows", "digest")).alias("kinds"), F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).where("kinds <> 1 or n <> 2")
    return wrong.select("file", (F.col("part") * LEAF).alias("first_row"), (F.col("part") * LEAF + F.col("rows") - 1).alias("last_row"))


def _written(index: Index, folder: Place) -> Index:
    """index as a generation, with its leaves and its manifest."""
    spark = index.documents.sparkSession
    out = stored(index, folder.url)
    found = _write(leaves(spark, folder.url), LEAVES, folder.url)
    manifest = REVISIONS | {"files": _digests(spark, folder.url, found), "documents": out.documents.count(), "schemas": {t: (out.parts[0].blocks if t == "blocks" else getattr(out, t)).schema.simpleString() for t in TABLES}}
    folder.of("manifest.json").write(json.dumps(manifest))
    return out


def save(index: Index, path: str, since: str | None = None, rebased: Callable[[Index], Index] | None = None) -> tuple[str, Index]:
    """index as the next commit at path; the name of its generation, and the index of its files.

    Without ``rebased`` index takes the place of whatever is there. With it, index is generation ``since`` with changes;
    if another is in force by now, rebased(that one) is saved instead. Raises ERR_CACHE_BUSY if other writers come first
    ATTEMPTS times, ERR_WRITE if a file cannot be written.
    """
    spark = index.documents.sparkSession
    place = Place(spark, path)
    if place.linked() or (place.exists() and not place.is_folder()):
        raise ConceptError("ERR_WRITE", path)
    folder, out = None, None
    try:
        for _ in range(ATTEMPTS):
            last, name = newest(place)
            if rebased is not None and name not in (None, since):
                if folder is not None:
                    folder.delete()
                    folder = None
                index, since = rebased(loaded(spark, path, name)[1]), name
            if folder is None:
                folder = place.of(f"gen-{uuid.uuid4().hex}")
                out = _written(index, folder)
            if _commit(place, last + 1).claim(folder.name):
                break
        else:
            raise ConceptError("ERR_CACHE_BUSY", path)
    except Exception as e:
        if folder is not None:
            folder.delete()
        raise e if isinstance(e, ConceptError) else ConceptError("ERR_WRITE", path) from e
    vacuum(spark, path)
    return folder.name, out


def _commit(place: Place, number: int) -> Place:
    return place.of(COMMITS).of(f"{number:020}")


def _numbers(place: Place) -> list[int]:
    return [int(name) for name in place.of(COMMITS).names() if re.fullmatch("[0-9]{20}", name)]


def newest(place: Place) -> tuple[int, str | None]:
    """The number of the commit in force and its generation, (0, None) if there is none; an error if that is no generation's name."""
    last = max(_numbers(place), default=0)
    if not last:
        return 0, None
    name = _commit(place, last).read(1000).strip()
    if not re.fullmatch("gen-[0-9a-f]{32}", name):
        raise OSError(f"{place.text} points outside itself")
    return last, name


def vacuum(spark: SparkSession, path: str, retain: float = RETAIN) -> list[str]:
    """Deletes what no reader or writer needs any more, and names it: generations that another commit replaced ``retain``
    seconds ago or earlier, with their commits, and generations of that age without a commit, whose writers are gone."""
    place = Place(spark, path)
    there = [n for n in place.names() if n.startswith("gen-")]  # before the commits, so that none made in between is missed
    numbers, named, old = _numbers(place), set(), []
    for number, after in zip(numbers, [*numbers[1:], None], strict=True):
        try:
            name = _commit(place, number).read(1000).strip()
            if after is not None and _commit(place, after).age() >= retain:
                old.append((number, name))
            named.add(name)
        except (OSError, Py4JJavaError):  # another vacuum was there first
            continue
    for number, _ in old:
        _commit(place, number).delete()
    gone = {name for _, name in old if name in there}
    for name in there:
        try:
            gone |= {name} if name not in named and place.of(name).age() >= retain else set()
        except Py4JJavaError:  # its writer took it away: another came first
            continue
    for name in gone:
        place.of(name).delete()
    return sorted(gone)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at path; only a true absence is a miss."""
    return Place(spark, path).exists()


def _once(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is repeated")
    return dict(pairs)


def _manifest(spark: SparkSession, path: str, name: str | None = None) -> tuple[dict, str]:
    """The manifest and the folder of a generation, by default of the one in force."""
    place = Place(spark, path)
    if place.linked() or not place.is_folder():
        raise ConceptError("ERR_CACHE_INVALID", path)
    try:
        name = name or newest(place)[1]
        if name is None and place.of("current").exists():
            raise ConceptError("ERR_CACHE_INCOMPATIBLE", path)  # saved before there were commits
        folder = place.of(name or "missing")
        manifest = json.loads(folder.of("manifest.json").read(), object_pairs_hook=_once)
        if not isinstance(manifest, dict):
            raise ValueError("a manifest is an object")
    except (OSError, ValueError) as e:
        raise ConceptError("ERR_CACHE_INVALID", path) from e
    return manifest, folder.url


def load(spark: SparkSession, path: str) -> Index:
    """The saved index; raises ERR_CACHE_INVALID or ERR_CACHE_INCOMPATIBLE."""
    return loaded(spark, path)[1]


def loaded(spark: SparkSession, path: str, name: str | None = None) -> tuple[str, Index]:
    """A generation's name and its index, by default of the one in force."""
    manifest, folder = _manifest(spark, path, name)
    if any(manifest.get(k) != v for k, v in REVISIONS.items()):
        raise ConceptError("ERR_CACHE_INCOMPATIBLE", path)
    try:
        if manifest.get("files") != _digests(spark, folder):
            raise ValueError("files differ from the manifest")
        found = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}
        if {t: f.schema.simpleString() for t, f in found.items()} != manifest.get("schemas"):
            raise ValueError("columns differ from the manifest")
        for table, frame in found.items():
            frame.select([F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[table]).fields])
        if found["documents"].count() != manifest.get("documents"):
            raise ValueError("documents are missing")
    except Exception as e:
        raise ConceptError("ERR_CACHE_INVALID", path) from e
    index = opened(**found)
    if not verify(index).isEmpty():
        raise ConceptError("ERR_CACHE_INVALID", path)
    return folder.rsplit("/", 1)[-1], index


def verify(index: Index) -> DataFrame:
    """(rule, key) of every disagreement between an index's tables; empty if they agree."""
    rule = lambda name, key: [F.lit(name).alias("rule"), F.col(key).alias("key")]
    found = indexing.violations(index.documents, index.sections)
    # each term and each beginning of one has its neighbourhood
    words = index.term_stats.select("term").distinct()
    lost = words.join(index.variants.where("term is not null and variant = stem").select("term"), "term", "left_anti").select(*rule("term without neighbourhood", "term"))
    # the postings are read once for their sections and once for their terms
    held = shared.cut(index.postings.select("section_id", "document_id", "strict").distinct())
    terms = shared.cut(index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")))
    strays = held.join(index.sections, "section_id", "left_anti").select(*rule("posting without section", "section_id"))
    owners = held.select("section_id", F.col("document_id").alias("owner")).join(index.sections, "section_id").where("owner <> document_id").select(*rule("posting of another document", "section_id"))
    counts = terms.join(index.term_stats, ["field", "term"], "full_outer").where("not (n <=> df)").select(*rule("wrong count of a term", "term"))
    # texts are analysed of sections without postings alone, and only their ids are shuffled to find these
    empty = shared.cut(index.sections.select("section_id").join(held, "section_id", "left_anti"))
    without = index.sections.join(indexing.small(empty, empty.count()), "section_id", "left_semi")
    bare = indexing.field_lengths(index.documents, without).where(F.size("tokens") > 0).select(*rule("section without postings", "section_id")).distinct()
    own = counted(terms, index.sections).select("field", F.struct("n_docs", F.round("avg_dl", 9)).alias("own"))
    means = own.join(index.field_stats.select("field", F.struct("n_docs", F.round("avg_dl", 9)).alias("held")), "field", "full_outer").where("not (own <=> held)").select(*rule("wrong statistics of a field", "field"))
    status = held.select("document_id", "strict").distinct().join(index.documents.select("document_id", (F.col("conformance") == "strict").alias("own")), "document_id").where("own <> strict").select(*rule("wrong conformance of a posting", "document_id"))
    tally = stats.added(stats.inventory(index.documents).unionByName(stats.minus(index.inventory))).select(F.lit("wrong count of documents").alias("rule"), F.concat_ws("=", "kind", "value").alias("key"))
    for more in (lost, strays, owners, counts, bare, means, status, tally):
        found = found.unionByName(more)
    return found


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the current generation's Parquet files, by its manifest."""
    return sum(length for length, _ in _manifest(spark, path)[0]["files"].values())
