"""Segments: an index as a list of immutable stored indexes, each with the documents that have gone from it since.

New documents become one new segment and nothing that is stored is rewritten: the documents that they stand for, or that
are removed, are noted beside the segments that hold them, with what their records count in the statistics. Statistics of
the whole are sums over segments. TIER segments of one size class (powers of TIER documents) are merged into one, so a
document is rewritten as often as the logarithm of the number of documents, and a search meets few segments.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared, store
from . import index as indexing
from . import stats
from .index import Index, Part

#: Segments of one size class that are merged, and the factor between classes.
TIER = 4
LOST = "field string, term string, df long"


@dataclass(frozen=True)
class Segment:
    """A stored index; gone: (document_id) of documents that are no longer there, n_gone of n_documents; lost, lost_fields,
    lost_inventory: what these count in its term and field statistics and in its inventory."""

    index: Index
    n_documents: int
    gone: DataFrame | None = None
    n_gone: int = 0
    lost: DataFrame | None = None
    lost_fields: DataFrame | None = None
    lost_inventory: DataFrame | None = None

    @property
    def live(self) -> int:
        return self.n_documents - self.n_gone

    def kept(self, frame: DataFrame) -> DataFrame:
        """The rows of documents that are still there."""
        return frame if self.gone is None else frame.join(indexing.small(self.gone, self.n_gone), "document_id", "left_anti").select(frame.columns)

    def without(self, ids: DataFrame) -> Segment:
        """This segment without the documents of these ids, (document_id), as far as it holds them."""
        names = self.index.documents.columns
        cut = shared.cut if self.index.parts else lambda frame: frame  # of what is not stored only what is asked is worked out
        documents = cut(self.kept(self.index.documents).join(ids.distinct(), "document_id", "left_semi").select(names))
        n = documents.count()
        if not n:
            return self
        own = documents.select("document_id")
        sections = cut(self.index.sections.join(indexing.small(own, n), "document_id", "left_semi").select(self.index.sections.columns))
        built = indexing.build(documents, sections)
        lost, fields = built.term_stats.select("field", "term", "df"), indexing.totals(built.field_stats)
        more = lambda old, new: cut(new if old is None else old.unionByName(new))
        return replace(self, gone=more(self.gone, own), n_gone=self.n_gone + n, lost=more(self.lost, lost), lost_fields=more(self.lost_fields, fields), lost_inventory=more(self.lost_inventory, built.inventory))


def segmented(index: Index) -> Segment:
    """An index as the first segment; stored first, if it is not."""
    index = index if index.parts else store.stored(index)
    return Segment(index, index.documents.count())


def planned(index: Index) -> Segment:
    """An index as a segment that is not stored: nothing is worked out before it is asked, and searches take it anew each time."""
    return Segment(index, index.documents.count())


def made(documents: DataFrame, sections: DataFrame) -> Segment:
    """A new segment of prepared documents and sections."""
    index = store.stored(indexing.build(documents, sections), rebuild=True)
    return Segment(index, index.documents.count())


def combined(segments: list[Segment]) -> Index:
    """All segments as one index."""
    if len(segments) == 1 and segments[0].gone is None:
        return segments[0].index
    union = lambda frames: _union(list(frames))
    term_stats = union([s.index.term_stats.select("field", "term", "df") for s in segments] + [s.lost.select("field", "term", (-F.col("df")).alias("df")) for s in segments if s.lost is not None])
    sums = union([indexing.totals(s.index.field_stats) for s in segments] + [s.lost_fields.select("field", (-F.col("n_docs")).alias("n_docs"), (-F.col("total")).alias("total")) for s in segments if s.lost_fields is not None])
    inventory = union([s.index.inventory for s in segments] + [stats.minus(s.lost_inventory) for s in segments if s.lost_inventory is not None])
    return Index(
        documents=union(s.kept(s.index.documents) for s in segments), sections=union(s.kept(s.index.sections) for s in segments), postings=union(s.kept(s.index.postings) for s in segments),
        term_stats=term_stats.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0"), field_stats=indexing.averaged(sums), variants=union(s.index.variants for s in segments), inventory=stats.added(inventory),
        parts=tuple(Part(p.blocks, p.gone if s.gone is None else s.gone, s.n_gone) for s in segments for p in s.index.parts) if all(s.index.parts for s in segments) else (),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merged(segments: list[Segment]) -> Segment:
    """One segment of the live documents of several; written anew."""
    index = store.stored(combined(segments))
    return Segment(index, sum(s.live for s in segments))


def changed(segments: list[Segment], gone: DataFrame, new: Segment | None) -> list[Segment]:
    """The segments without the documents of gone, (document_id), and with the new one; merged by size classes."""
    left = [s.without(gone) for s in segments]
    out = [s for s in left if s.live] + ([new] if new is not None and new.live else [])
    while True:
        classes: dict[int, list[Segment]] = {}
        for s in out:
            classes.setdefault(int(math.log(s.live, TIER)), []).append(s)
        full = next((own for _, own in sorted(classes.items()) if len(own) >= TIER), None)
        if full is None:
            return out or left[:1]
        out = [s for s in out if s not in full] + [merged(full)]
