"""Ranked search of any number of queries at once.

First the dictionary is asked: the query terms' prefix and fuzzy alternatives and their document frequencies. Fuzzy
alternatives share a string of their neighbourhoods with the query term and are met by an equi-join; an index that is not
stored has its dictionary compared with a few such terms. Up to EXPANSIONS of
them come to the driver and go into the second plan as literals, so the scan of the postings skips the row groups without
these terms; more are joined. There of a term's alternatives in a field the best counts, fields and terms
add up. Contributions are decimals, so sums do not depend on order. The best section of each document is ranked by score,
conformance and section id, all after one shuffle by query and document and one of the best of each part by query. At
last the ranked sections alone, up to FETCHED of them by literal ids, are read for their hits.

Queries whose terms have PRUNE_FROM postings or more in a stored index are pruned, exactly. The first blocks of the terms
give each query a score that its last hit has at least (a sum of some of a section's contributions is below its score).
Pairs of a query term and a field that could not reach that score even together give no candidates; of the others only
blocks and postings are read whose bound reaches it with all that the other pairs could add. What the pairs left out add
to the candidates is then read for these alone. Scores that are equal to the bound stay, so ties are settled as ever.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.edit_distance import distance
from ..plans.options import _TOKEN, FIELDS, MAX_TERM, Options, among, condition, edits, listed, quoted, tokens
from ..sources import shared
from .index import BROADCAST_ROWS, K1, STEM, B, Index, deletions, neighbourhoods, small

#: Fixed values of ranking: the weights of the alternatives.
FUZZY_WEIGHT, PREFIX_WEIGHT = 0.70, 0.50
LOOKBEHIND = 80
EXACT = "decimal(28,12)"
#: Alternatives that the driver takes in, terms and ids that a scan is given as literals, prefixes that are tested one by one.
EXPANSIONS = 20_000
#: Alternatives up to which they are sent to all executors, so that postings need not be shuffled to meet them.
SENT = 1_000_000
LITERALS = 5_000
FETCHED = 5_000
#: Postings of the query terms from which searches of a stored index are pruned, and what a bound is eased by.
PRUNE_FROM = 20_000_000
EASE = 1e-6
#: Hits up to which snippets are cut by the driver, which spares the start of Python workers.
FEW = 200
PREFIXES = 16
#: Fuzzy terms that every term of the texts is compared with; for more of them the dictionary is worked out first.
EDITED = 4
TERM = "query_id long, pos int, term string, edits int, prefix boolean, n_terms int"
HIT = "query_id long, rank int, document_id string, title string, section_id string, score double, conformance string, matched_fields array<string>, heading_path string, path string, start_line int, end_line int, snippet string"


def query_terms(queries: dict[int, str], options: Options) -> list[tuple]:
    """Rows of TERM for the queries that have terms."""
    out = []
    for query, text in queries.items():
        found = tokens(text.strip())
        last = len(found) - 1
        out += [(query, i, t, edits(t, options), i == last and len(t) >= options.prefix_from, len(found)) for i, t in enumerate(found)]
    return out


def _within(near: DataFrame) -> DataFrame:
    """Rows of (…, term, index_term, reach, whole) whose edit distance is at most reach."""

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, bool(p)) for x, y, p in zip(a, b, prefix, strict=True)], dtype="int32")

    return near.where(apart("term", "index_term", ~F.col("whole")) <= F.col("edits"))


def _near(whole: DataFrame, begun: DataFrame | None, columns: list[str]) -> list[DataFrame]:
    """Rows of alternatives() of the pairs of a query term and a term, and of it and a term it may begin, that are within its edits."""
    reach = F.col("edits")
    # a transposition is one edit here and two of Levenshtein's
    near = whole.where((F.abs(F.length("index_term") - F.length("term")) <= reach) & (F.levenshtein("index_term", "term") <= 2 * reach)).select(*columns, "term", "edits").distinct()
    parts = [_within(near.withColumn("whole", F.lit(True))).select(*columns, F.lit(FUZZY_WEIGHT).alias("weight"))]
    if begun is not None:
        cut = lambda k: F.levenshtein(F.col("term"), F.substring(F.col("index_term"), F.lit(1), F.greatest(F.length("term") + k, F.lit(0))))
        begun = begun.where((F.length("index_term") >= F.length("term") - reach) & (F.least(*[cut(k) for k in range(-2, 3)]) <= 2 * reach)).select(*columns, "term", "edits").distinct()
        parts.append(_within(begun.withColumn("whole", F.lit(False))).select(*columns, F.lit(PREFIX_WEIGHT).alias("weight")))
    return parts


def _meeting(rows: list[tuple], options: Options) -> str | None:
    """A condition that all terms fulfil which query terms can meet, as SQL; None if there are too many to be tested one by one."""
    begins = {r[2] for r in rows if r[4] and (not options.fuzzy_prefix or r[3] == 0)}
    edited = {r[2:5] for r in rows if r[3] > 0}
    exact = {r[2] for r in rows}
    if len(begins) > PREFIXES or len(edited) > EDITED or len(exact) > LITERALS:
        return None
    parts = [listed("term", sorted(exact)), *(f"startswith(term, {quoted(t)})" for t in sorted(begins))]
    for term, reach, prefix in sorted(edited):
        # as in _near(); what is near enough by this is compared exactly there
        n, near = len(term), lambda x: f"levenshtein({x}, {quoted(term)}, {2 * reach}) >= 0"  # noqa: B023
        parts.append(f"(length(term) BETWEEN {n - reach} AND {n + reach} AND {near('term')})")
        if options.fuzzy_prefix and prefix:
            parts.append(f"(length(term) >= {n - reach} AND ({' OR '.join(near(f'substring(term, 1, {max(n + k, 0)})') for k in range(-reach, reach + 1))}))")
    return " OR ".join(parts)


def gathered(index: Index, rows: list[tuple], options: Options) -> Index:
    """index with all that query terms can meet, if it is not stored, so that its texts are read once."""
    wanted = None if index.lengths is None else _meeting(rows, options)
    return index if wanted is None else index.gathered(wanted)


def _looked_up(index: Index, rows: list[tuple], options: Options) -> Index:
    """index with the part of its dictionary that query terms can meet, so that texts are read once for all of them."""
    begins = [r for r in rows if r[4] and (not options.fuzzy_prefix or r[3] == 0)]
    exact = sorted({r[2] for r in rows})
    wanted = "true"
    if len(begins) <= PREFIXES and len(exact) <= LITERALS and not any(r[3] > 0 for r in rows):
        wanted = " OR ".join([listed("term", exact), *(f"startswith(term, {quoted(r[2])})" for r in begins)])
    term_stats = shared.cut(_of_fields(index.dictionary(wanted), options))
    return replace(index, term_stats=term_stats, variants=neighbourhoods(term_stats))


def alternatives(index: Index, rows: list[tuple], options: Options) -> DataFrame | None:
    """(query_id, pos, n_terms, index_term, weight) of the prefix and fuzzy alternatives in the dictionary; None if no term has any."""
    spark = index.documents.sparkSession
    begins = [r for r in rows if r[4] and (not options.fuzzy_prefix or r[3] == 0)]
    edited = [r for r in rows if r[3] > 0]
    words = _of_fields(index.term_stats, options).select(F.col("term").alias("index_term"))
    columns = ["query_id", "pos", "n_terms", "index_term"]
    parts = []
    if begins:
        asked = small(spark.createDataFrame(_arrow(begins)), len(begins)).withColumn("head", F.substring("term", 1, 3))
        held = words
        if len(begins) <= PREFIXES:  # few prefixes are ranges that a scan of sorted terms can skip to
            any_ = F.lit(False)
            for r in begins:
                any_ = any_ | F.col("index_term").startswith(r[2])
            held = held.where(any_)
        # prefixes meet on up to three first letters
        sizes = F.sequence(F.lit(min(options.prefix_from, 3)), F.lit(3))
        held = held.distinct().select("index_term", F.explode(F.array_distinct(F.transform(sizes, lambda n: F.substring(F.col("index_term"), F.lit(1), n)))).alias("head"))
        found = held.join(asked, "head").where(F.col("index_term").startswith(F.col("term")) & (F.length("head") == F.least(F.length("term"), F.lit(3))))
        parts.append(found.select(*columns, F.lit(PREFIX_WEIGHT).alias("weight")).distinct())
    if edited and not index.parts and len(edited) <= PREFIXES:
        # without stored neighbourhoods the dictionary is compared with a few terms itself
        met = words.distinct().crossJoin(F.broadcast(spark.createDataFrame(_arrow(edited))))
        parts += _near(met, met.where("prefix") if options.fuzzy_prefix and any(r[4] for r in edited) else None, columns)
    elif edited:
        # what both sides leave after deletions brings them together; the true distance is worked out for these few
        asked = spark.createDataFrame(_neighbours(edited))
        held = index.variants
        n_variants = sum(len(_variants(r)) for r in edited)
        if n_variants <= LITERALS:
            held = held.where(among("variant", sorted({v for r in edited for v, _ in _variants(r)})))
        held = held.withColumnRenamed("term", "index_term").where(F.length("stem") - F.length("variant") <= max(r[3] for r in edited))
        met = held.join(small(asked, n_variants), "variant").where(F.length("stem") - F.length("variant") <= F.col("edits"))
        begun = None
        if options.fuzzy_prefix and any(r[4] for r in edited):
            stems = met.where("index_term is null and prefix").where(F.levenshtein("stem", F.substring("term", 1, STEM)) <= 2 * F.col("edits")).select("query_id", "pos", "n_terms", "term", "edits", "stem").distinct()
            sizes = sorted({n for r in edited if r[4] for n in range(max(1, min(STEM, len(r[2]) - r[3])), min(STEM, len(r[2]) + r[3]) + 1)})
            begun = words.distinct().select("index_term", F.explode(F.array_distinct(F.array(*[F.substring("index_term", 1, n) for n in sizes]))).alias("stem")).join(stems, "stem")
        parts += _near(met.where("index_term is not null"), begun, columns)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _variants(row: tuple) -> list[tuple[str, int]]:
    """(variant, deletions) of a query term's stem, within its edits."""
    _, _, term, reach, *_ = row
    size = min(len(term), STEM)
    return [(v, size - len(v)) for v in deletions(term) if size - len(v) <= reach]


def _neighbours(rows: list[tuple]) -> pa.Table:
    """Rows of TERM with each variant of their terms."""
    wide = [(*r, v) for r in rows for v, _ in _variants(r)]
    return _arrow([r[:6] for r in wide]).append_column("variant", pa.array([r[6] for r in wide], pa.string()))


def _arrow(rows: list[tuple]) -> pa.Table:
    """Rows of TERM as a table that becomes a part of the plan itself."""
    kinds = {"query_id": pa.int64(), "pos": pa.int32(), "term": pa.string(), "edits": pa.int32(), "prefix": pa.bool_(), "n_terms": pa.int32()}
    return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows, strict=True), strict=True)})


_MET = pa.schema([("query_id", pa.int64()), ("pos", pa.int32()), ("n_terms", pa.int32()), ("index_term", pa.string()), ("weight", pa.float64()), ("df", pa.map_(pa.string(), pa.int64()))])


def _met_table(met: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*met, strict=True) if met else [[]] * 6, _MET, strict=True)], schema=_MET)


def expand(index: Index, rows: list[tuple], options: Options) -> tuple[DataFrame, list[tuple] | None]:
    """What query terms meet, as (query_id, pos, n_terms, index_term, weight, df), and the same rows as a list.

    weight is null for the exact term, which has its document frequencies by field; there is no list if there are more
    alternatives than EXPANSIONS.
    """
    spark = index.documents.sparkSession
    exact = sorted({r[2] for r in rows})
    index = index if index.lengths is None else _looked_up(index, rows, options)
    stats = _of_fields(index.term_stats, options)
    asked = stats.where(among("term", exact)) if len(exact) <= LITERALS else stats.join(F.broadcast(spark.createDataFrame(pa.table({"term": exact}))) if len(exact) <= BROADCAST_ROWS else spark.createDataFrame(pa.table({"term": exact})), "term", "left_semi")
    asked = asked.select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n_terms"), F.col("term").alias("index_term"), F.lit(None).cast("double").alias("weight"), "field", F.col("df").cast("long").alias("df"))
    others = alternatives(index, rows, options)
    if others is not None:
        # one job brings the frequencies and the alternatives, if these are few
        some = others.limit(EXPANSIONS + 1).withColumns({"field": F.lit(None).cast("string"), "df": F.lit(None).cast("long")})
        asked = asked.unionByName(some)
    found = asked.collect()
    df: dict[str, list] = {}
    for r in found:
        if r.field is not None:
            df.setdefault(r.index_term, []).append((r.field, r.df))
    own = [(q, p, n, t, None, df[t]) for q, p, t, _, _, n in rows if t in df]
    more = [(r.query_id, r.pos, r.n_terms, r.index_term, r.weight, None) for r in found if r.field is None]
    many = len(more) > EXPANSIONS
    met = own if many else own + more
    frame = spark.createDataFrame(_met_table(met))
    if many:
        others = shared.cut(others)  # read for the joins and for what they begin with
        sent = F.broadcast if others.count() + len(own) <= SENT else lambda x: x
        return sent(frame.unionByName(others.withColumn("df", F.lit(None).cast("map<string,bigint>")))), None
    return small(frame, len(met)), met


def bm25(tf: Column, dl: Column, df: Column, n: Column, avg: Column) -> Column:
    """Okapi BM25 of one term in one field."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avg))


def _by_field(values: dict[str, float | int], kind: str) -> Column:
    """The value of the row's field."""
    return F.expr("CASE field " + " ".join(f"WHEN '{name}' THEN CAST('{value!r}' AS {kind})" for name, value in values.items()) + " END")


def _of_fields(frame: DataFrame, options: Options) -> DataFrame:
    """The rows of the fields that are searched."""
    return frame if set(options.fields) == set(FIELDS) else frame.where(among("field", list(options.fields)))


def _wanted(terms: str | None, options: Options) -> Column:
    """The condition on term and field of postings, with one on the term as SQL."""
    wanted = F.lit(True) if set(options.fields) == set(FIELDS) else among("field", list(options.fields))
    return wanted if terms is None else wanted & F.expr(terms)


def _terms(frame: DataFrame, met: list[tuple] | None) -> str | None:
    """A condition that the terms which rows of expand() meet fulfil, as SQL: the terms themselves or, of many, their first three letters."""
    if met is not None:
        terms = sorted({m[3] for m in met})
        if len(terms) <= LITERALS:
            return listed("term", terms)
        begun = sorted({t[:3] for t in terms})
    else:
        begun = sorted(r[0] for r in frame.select(F.substring("index_term", 1, 3)).distinct().limit(LITERALS + 1).collect())
    return listed("substring(term, 1, 3)", begun) if len(begun) <= LITERALS else None


def _filtered(index: Index, postings: DataFrame, options: Options) -> DataFrame:
    where = condition(options)
    return postings if where is None else postings.join(index.documents.where(where).select("document_id"), "document_id", "left_semi")


def _score(index: Index, options: Options) -> Column:
    """BM25 of a row with field, tf, dl and df."""
    known = index.averages or {name: (0, math.nan) for name in options.fields}
    return bm25(F.col("tf"), F.col("dl"), F.col("df"), _by_field({k: n for k, (n, _) in known.items()}, "long"), _by_field({k: float(a) for k, (_, a) in known.items()}, "double"))


def _gained(index: Index, postings: DataFrame, met: DataFrame, options: Options, *more: str) -> DataFrame:
    found = postings.join(met, postings.term == met.index_term).drop("term").withColumn("df", F.element_at("df", F.col("field")))
    return found.select("query_id", "section_id", "document_id", "strict", "n_terms", "pos", "field", "index_term", F.coalesce("weight", _score(index, options)).alias("gain"), *more)


def matches(index: Index, rows: list[tuple], options: Options) -> DataFrame:
    """(query_id, section_id, document_id, strict, n_terms, pos, field, index_term, gain) of every alternative that applies."""
    index = gathered(index, rows, options)
    met, known = expand(index, rows, options)
    return _matched(index, met, known, options)


def _matched(index: Index, met: DataFrame, known: list[tuple] | None, options: Options) -> DataFrame:
    """matches() of what expand() gave."""
    terms = _terms(met, known)
    return _gained(index, _filtered(index, index.among(_wanted(terms, options), terms=terms), options), met, options)


def floors(index: Index, met: list[tuple], options: Options) -> dict[int, float]:
    """A score that the last hit of a query has at least, from the first blocks of its terms; queries with fewer hits have none."""
    spark = index.documents.sparkSession
    exact = [m for m in met if m[4] is None]
    frame = small(spark.createDataFrame(_met_table(exact)), len(exact))
    heads = _filtered(index, index.among(_wanted(_terms(frame, exact), options), lambda blocks: blocks.where("head")), options)
    best = ranked(scores(_gained(index, heads, frame, options), options), options)
    return {r.query_id: float(r.least) for r in best.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == options.limit).collect()}


def limits(index: Index, met: list[tuple], options: Options, floor: dict[int, float]) -> dict[tuple[int, int, str], float | None]:
    """What a posting must contribute at least, by (query, position, field), to be of a candidate; None if it need not be asked for candidates.

    A pair of position and field contributes its best alternative, at most its exact term's idf times K1 + 1 or its
    greatest weight, times the field's boost.
    """
    most: dict[int, dict] = {}
    for query, pos, _, _, weight, df in met:
        own = most.setdefault(query, {})
        for field, n in df if weight is None else [(f, None) for f in options.fields]:
            if weight is None:
                total = index.averages[field][0]
                gain = math.log(1 + (total - n + 0.5) / (n + 0.5)) * (K1 + 1)
            exact, other = own.get((pos, field), (0.0, 0.0))
            boost = options.boost[field]
            own[pos, field] = (max(exact, boost * gain), other) if weight is None else (exact, max(other, boost * weight))
    out: dict = {}
    for query, own in most.items():
        least = floor.get(query)
        total = sum(max(x) for x in own.values())
        sunk = 0.0
        for (pos, field), (exact, other) in sorted(own.items(), key=lambda x: max(x[1])):
            bound = max(exact, other)
            if least is None:
                out[query, pos, field] = -math.inf
            elif sunk + bound < least - EASE:
                sunk += bound
                out[query, pos, field] = None
            else:
                need = least - EASE - (total - bound)
                # an alternative of a constant weight may carry what a posting of the exact term does not
                out[query, pos, field] = need if need > other else -math.inf
    return out


_LIMITED = pa.schema([*_MET, ("need", pa.map_(pa.string(), pa.float64())), ("rest", pa.list_(pa.string()))])


def reaching(index: Index, met: list[tuple], options: Options, need: dict, others: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that keeps the blocks of which some posting may contribute what a query needs.

    others: (index_term, need) of further alternatives, whose blocks of the fields in need are kept.
    """
    spark = index.documents.sparkSession
    least: dict[tuple[str, str], list] = {}
    for query, pos, _, term, weight, df in met:
        for field, n in df if weight is None else [(f, 0) for f in options.fields]:
            own = need[query, pos, field]
            if own is not None:
                held = least.setdefault((term, field), [math.inf, 1])
                held[0] = min(held[0], own if weight is None else -math.inf)
                held[1] = max(held[1], n)
    rows = [(t, f, x, n) for (t, f), (x, n) in least.items()]
    table = pa.table({"term": pa.array([r[0] for r in rows], pa.string()), "field": pa.array([r[1] for r in rows], pa.string()), "least": pa.array([r[2] for r in rows], pa.float64()), "df": pa.array([r[3] for r in rows], pa.int64())})
    frame = small(spark.createDataFrame(table), len(rows))
    if others is not None:
        more = others.select(F.col("index_term").alias("term"), F.explode(F.map_keys("need")).alias("field"), F.lit(-math.inf).alias("least"), F.lit(1).cast("long").alias("df"))
        frame = shared.cut(frame.unionByName(more).groupBy("term", "field").agg(F.min("least").alias("least"), F.max("df").alias("df")))
        frame = F.broadcast(frame) if frame.count() <= SENT else frame
    boost = _by_field(options.boost, "double")

    def kept(blocks: DataFrame) -> DataFrame:
        names = blocks.columns
        held = blocks.join(frame, ["term", "field"])
        known = index.averages
        total, mean = _by_field({k: n for k, (n, _) in known.items()}, "long"), _by_field({k: float(a) for k, (_, a) in known.items()}, "double")
        return held.where((F.col("least") == -math.inf) | F.exists("peaks", lambda p: boost * bm25(p["tf"], p["dl"], F.col("df"), total, mean) >= F.col("least"))).select(names)

    return kept


def pruned(index: Index, met: list[tuple] | None, options: Options, frame: DataFrame | None = None) -> DataFrame:
    """Rows as of matches() that hold all of those of every section that can be a hit.

    met is the list that expand() gives; if there is none, as there are too many alternatives, its frame is needed.
    """
    spark = index.documents.sparkSession
    others, most = None, []
    if met is None:
        met = [(r.query_id, r.pos, r.n_terms, r.index_term, None, list(r.df.items())) for r in frame.where("weight is null").collect()]  # one for each query term at the most
        others = frame.where("weight is not null").drop("df")
        # of alternatives the bounds ask for the greatest weight of each query term alone
        most = [(r.query_id, r.pos, None, None, r.weight, None) for r in others.groupBy("query_id", "pos").agg(F.max("weight").alias("weight")).collect()]
    need = limits(index, met + most, options, floors(index, met, options))
    if others is not None:
        return _pruned_many(index, met, others, options, need)
    wide = [(*m, [(f, x) for f in options.fields if (x := need.get((m[0], m[1], f))) is not None], [f for f in options.fields if need.get((m[0], m[1], f), 0) is None]) for m in met]
    table = lambda rows: pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _LIMITED, strict=True)], schema=_LIMITED)
    asked, rest = [w for w in wide if w[6]], [w for w in wide if w[7]]
    boost = _by_field(options.boost, "double")
    of = lambda rows: _wanted(_terms(None, rows), options)
    first = _filtered(index, index.among(of(asked), reaching(index, met, options, need)), options)
    first = _gained(index, first, small(spark.createDataFrame(table(asked)), len(asked)), options, "need")
    names = [c for c in first.columns if c != "need"]
    first = first.withColumn("need", F.element_at("need", F.col("field"))).where(F.col("need").isNotNull() & (F.col("gain") * boost >= F.col("need"))).select(names)
    if not rest:
        return first
    first = shared.cut(first)  # read twice, and its size decides how the rest is joined
    n = first.count()
    candidates = first.select("query_id", "section_id").distinct()
    others = _filtered(index, index.among(of(rest)), options).join(small(candidates.select("section_id").distinct(), n), "section_id", "left_semi")
    others = _gained(index, others, small(spark.createDataFrame(table(rest)), len(rest)), options, "rest").where(F.array_contains("rest", F.col("field"))).drop("rest")
    return first.unionByName(others.join(small(candidates, n), ["query_id", "section_id"], "left_semi").select(names))


def _pruned_many(index: Index, met: list[tuple], others: DataFrame, options: Options, need: dict) -> DataFrame:
    """pruned() with alternatives as a frame: the same two passes, with what they need joined to them."""
    spark = index.documents.sparkSession
    pairs = sorted({(q, p) for q, p, _ in need})
    kinds = [pa.field("query_id", pa.int64()), pa.field("pos", pa.int32()), *(_LIMITED.field(n) for n in ("need", "rest"))]
    values = [(q, p, [(f, x) for f in options.fields if (x := need.get((q, p, f))) is not None], [f for f in options.fields if need.get((q, p, f), 0) is None]) for q, p in pairs]
    table = spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(zip(*values, strict=True), kinds, strict=True)], schema=pa.schema(kinds)))
    own = spark.createDataFrame(_met_table(met))
    every = shared.cut(own.unionByName(others.withColumn("df", F.lit(None).cast("map<string,bigint>"))).join(small(table, len(pairs)), ["query_id", "pos"]))
    sent = F.broadcast if every.count() <= SENT else lambda x: x
    boost = _by_field(options.boost, "double")
    asked, rest = every.where(F.size("need") > 0), every.where(F.size("rest") > 0)
    kept = reaching(index, met, options, need, asked.where("weight is not null").select("index_term", "need"))
    first = _gained(index, _filtered(index, index.among(_wanted(_terms(asked, None), options), kept), options), sent(asked), options, "need")
    names = [c for c in first.columns if c != "need"]
    first = shared.cut(first.withColumn("need", F.element_at("need", F.col("field"))).where(F.col("need").isNotNull() & (F.col("gain") * boost >= F.col("need"))).select(names))
    n = first.count()
    candidates = first.select("query_id", "section_id").distinct()
    terms = sent(rest.select(F.col("index_term").alias("term")))
    more = _filtered(index, index.among(_wanted(_terms(rest, None), options), lambda blocks: blocks.join(terms, "term", "left_semi").select(blocks.columns)), options).join(small(candidates.select("section_id").distinct(), n), "section_id", "left_semi")
    more = _gained(index, more, sent(rest), options, "rest").where(F.array_contains("rest", F.col("field"))).drop("rest")
    return first.unionByName(more.join(small(candidates, n), ["query_id", "section_id"], "left_semi").select(names))


def scores(found: DataFrame, options: Options) -> DataFrame:
    """(query_id, section_id, document_id, strict, score, fields) of the sections that match."""
    boost = _by_field(options.boost, "double")
    # one shuffle serves the sums and the choice of each document's best section
    met = found.repartition("query_id", "document_id")
    best = met.groupBy("query_id", "document_id", "section_id", "strict", "n_terms", "pos", "field").agg(F.max("gain").alias("gain"))
    total = best.groupBy("query_id", "document_id", "section_id", "strict", "n_terms").agg(
        F.sum((F.col("gain") * boost).cast(EXACT)).cast("decimal(38,12)").alias("score"), F.size(F.collect_set("pos")).alias("met"), F.collect_set("field").alias("fields")
    )
    return (total.where("met = n_terms") if options.match == "all" else total).select("query_id", "section_id", "document_id", "strict", "score", "fields")


def ranked(scored: DataFrame, options: Options) -> DataFrame:
    """The best section of each document, numbered by rank within each query, up to the limit."""
    order = [F.desc("score"), F.desc("strict"), "section_id"]
    best = scored.withColumn("of_document", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(*order))).where("of_document = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= options.limit).drop("of_document")


def units(text: str) -> int:
    """UTF-16 code units of text."""
    return len(text) + sum(c > "￿" for c in text)


def window(text: str, anchor: int | None, length: int) -> str:
    """The part of text around the character anchor, at most `length` UTF-16 units, with dots where it is cut."""
    start = anchor or 0
    left = LOOKBEHIND
    while start and anchor and left >= units(text[start - 1]):
        left -= units(text[start - 1])
        start -= 1
    end, left = start, length
    while end < len(text) and left >= units(text[end]):
        left -= units(text[end])
        end += 1
    cut = text[start:end].strip()
    return ("…" if start else "") + cut + ("…" if end < len(text) else "")


def anchor(text: str, terms: list[tuple[str, int, bool]], fuzzy_prefix: bool) -> int | None:
    """Where the first token of text begins that some (term, edits, prefix) accepts."""
    for found in _TOKEN.finditer(text):
        token = found[0].lower()
        if len(token.encode()) > MAX_TERM:
            continue
        for term, reach, prefix in terms:
            if token == term or (prefix and token.startswith(term)) or (reach and distance(term, token) <= reach) or (reach and prefix and fuzzy_prefix and distance(term, token, True) <= reach):
                return found.start()
    return None


def hits(index: Index, best: DataFrame, rows: list[tuple], options: Options) -> DataFrame:
    """Rows of HIT for ranked sections; bodies are read and snippets cut for these alone."""
    spark = index.documents.sparkSession
    asked: dict[int, list] = {}
    for query, _, term, reach, prefix, _ in rows:
        asked.setdefault(query, []).append({"term": term, "edits": reach, "prefix": prefix})
    sections = index.sections.select("section_id", "heading_path", "text", "start_line", "end_line")
    documents = index.documents.select("document_id", "title", "path")
    body, length, fuzzy_prefix = "body" in options.fields, options.snippet_length, options.fuzzy_prefix

    def cut(text: str, asked: list[dict]) -> str:
        return window(text, anchor(text, [(x["term"], x["edits"], x["prefix"]) for x in asked], fuzzy_prefix) if body else None, length)

    if options.limit * len(asked) <= FETCHED:
        table = best.toArrow()  # `limit` rows of each query
        sections = sections.where(among("section_id", table.column("section_id").to_pylist()))
        documents = documents.where(among("document_id", sorted(set(table.column("document_id").to_pylist()))))
        if len(table) <= FEW:
            return _few(table.to_pylist(), sections, documents, asked, cut, options)
        best = F.broadcast(spark.createDataFrame(table))
    kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("prefix", pa.bool_())]))
    terms = spark.createDataFrame(pa.table({"query_id": pa.array(list(asked), pa.int64()), "asked": pa.array(list(asked.values()), kind)}))

    @F.pandas_udf("string")
    def snippet(text: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([cut(t, q) for t, q in zip(text, asked, strict=True)], dtype=object)

    order = F.array(*map(F.lit, options.fields))
    found = sections.join(best, "section_id").join(documents, "document_id").join(small(terms, len(asked)), "query_id")
    return found.select(
        "query_id", "rank", "document_id", "title", "section_id", F.round("score", 6).cast("double").alias("score"), F.when(F.col("strict"), "strict").otherwise("degraded").alias("conformance"),
        F.filter(order, lambda f: F.array_contains("fields", f)).alias("matched_fields"), "heading_path", "path", "start_line", "end_line", snippet("text", "asked").alias("snippet"),
    )


def _few(best: list[dict], sections: DataFrame, documents: DataFrame, asked: dict[int, list], cut, options: Options) -> DataFrame:
    """Rows of HIT of a few ranked sections, whose records are fetched."""
    spark = sections.sparkSession
    if not best:
        return spark.createDataFrame([], HIT)
    texts = {r.section_id: r for r in sections.collect()}
    named = {r.document_id: r for r in documents.collect()}
    rows = []
    for b in best:
        own, of = texts[b["section_id"]], named[b["document_id"]]
        rows.append(b | own.asDict() | of.asDict() | {
            "score": float(round(b["score"], 6)), "conformance": "strict" if b["strict"] else "degraded", "matched_fields": [f for f in options.fields if f in b["fields"]], "snippet": cut(own.text, asked[b["query_id"]]),
        })
    kind = StructType.fromDDL(HIT)
    return spark.createDataFrame(pa.Table.from_pylist([{f.name: r[f.name] for f in kind.fields} for r in rows], to_arrow_schema(kind)), kind)


def search_many(index: Index, queries: dict[int, str], options: Options) -> DataFrame:
    """Hits of every query under one set of options, as rows of HIT."""
    spark: SparkSession = index.documents.sparkSession
    rows = query_terms(queries, options)
    if not rows or options.limit == 0:
        return spark.createDataFrame([], HIT)
    index = gathered(index, rows, options)
    met, known = expand(index, rows, options)
    heavy = bool(index.parts) and known is not None and sum(n for m in known for _, n in m[5] or ()) >= PRUNE_FROM
    found = pruned(index, known, options) if heavy else _matched(index, met, known, options)
    return hits(index, ranked(scores(found, options), options), rows, options)
