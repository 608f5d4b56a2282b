"""Exact top-k inner-product search of a stated query set against all rows, by term-at-a-time accumulation.

Terms are vector components, made integers by floor(scale * x). Rows are cut into blocks, and every block of queries
meets every block of candidates in one task. There both sides are sparse: the candidates' non-zero weights lie in a
posting list for each term (places and weights), and a query row is its own non-zero terms. Term by term the postings,
times the query rows' weights, are scattered into dense arrays of scores, one array for each query; a posting list that
holds most candidates of the block is filled up with zeros and added without its places. Of each array the k best are selected by partition,
and the blocks' selections are merged by query.

Scores are exact: they are summed in 16, 32 or 64 bits, whichever holds the product of the two blocks' largest norms,
which bounds every partial sum, and beyond that as whole numbers of any size. A component or a ranked score that does
not fit in a long is refused with an error (ArithmeticError in the task), never wrapped or left out.

Scale: a task holds one block of each side, so memory does not grow. Queries are a stated share of the rows, so work
grows with rows times queries, as in any exhaustive search; each row travels once for each block of the other side.
Blocks are numbered by a hash of vec_id, and equal vectors do not meet in one task. The merge gets at most k rows of a
query from each block of candidates.

Cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a null vec_id; vectors
of another length than most share what terms they have (a missing component is 0), and an empty one scores 0 with all.
Rows that repeat a vec_id and its vector count once. Of a vec_id with several vectors each is a candidate of its own,
and the queries' lists are ranked together; the query's own vec_id is never its candidate. Fewer candidates than k give
fewer ranks, ties go to the smaller vec_id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import load, saved

SCALE = 64
K = 20
EVERY = 20
#: Rows of a block of queries and of candidates.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
#: Query rows whose score arrays are filled at once, and of which the best are selected at once.
_ROWS = 32
_SELECTED = 256
#: Share of a block's candidates (or of _ROWS query rows) from which a term's list is filled up with zeros.
_DENSE = 0.25


class Sparse:
    """Integer rows as the non-zero entries (row, term, weight) of lists of weights, by term and then by row."""

    def __init__(self, lists: pa.ListArray):
        size = np.diff(np.asarray(lists.offsets))
        weight = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(size)), size)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(size) - size, size)
        used = np.flatnonzero(weight)
        self.rows = len(size)
        self._set(row[used], term[used], weight[used])

    def _set(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        self.row, self.term, self.weight = row[order], term[order], weight[order]
        self.terms = np.unique(self.term)

    def norm(self) -> int:
        """An upper bound of the rows' Euclidean norms."""
        squares = np.bincount(self.row, weights=self.weight.astype(np.float64) ** 2, minlength=max(1, self.rows))
        return int(np.ceil(np.sqrt(squares.max(initial=0)) * (1 + 1e-9))) + 1

    def part(self, first: int, last: int) -> Sparse:
        """Rows first to last of these, numbered from 0."""
        out = Sparse.__new__(Sparse)
        own = np.flatnonzero((self.row >= first) & (self.row < last))
        out.rows = last - first
        out._set(self.row[own] - first, self.term[own], self.weight[own])
        return out

    def postings(self, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        """Of each term the rows that have it and their weights; None and the weights of all rows if most have it."""
        weight = self.weight.astype(kind)
        edges = np.append(np.searchsorted(self.term, self.terms), len(self.term))
        out: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, a, b in zip(self.terms.tolist(), edges[:-1], edges[1:], strict=True):
            out[t] = self.row[a:b], weight[a:b]
            if b - a >= _DENSE * self.rows:
                full = np.zeros(self.rows, kind)
                full[self.row[a:b]] = weight[a:b]
                out[t] = None, full
        return out


def width(bound: int) -> type:
    """The narrowest type in which sums of that size at most are exact."""
    return np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def scores(queries: Sparse, held: dict[int, tuple[np.ndarray | None, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Inner products of query rows with n candidates given by postings, one array for each query."""
    out = np.zeros((queries.rows, n), kind)
    step = np.empty((_ROWS, n), kind)
    for a in range(0, queries.rows, _ROWS):
        rows = queries.part(a, min(a + _ROWS, queries.rows))
        into = out[a : a + rows.rows]
        for term, (at, weight) in rows.postings(kind).items():
            if term not in held:
                continue
            places, own = held[term]
            part = step.reshape(-1)[: len(weight) * len(own)].reshape(len(weight), len(own))
            np.multiply(weight[:, None], own, out=part)
            if at is None and places is None:
                into += part
            elif places is None:
                into[at] += part
            elif at is None:
                into[:, places] += part
            else:
                into[at[:, None], places] += part
    return out


def best(found: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to the smaller id; a row's own id is left out.

    ids must rise along the columns.
    """
    if not found.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mine = ids == own[:, None]
    key = -found - 1 if found.dtype == object else ~found  # falls as the score rises and cannot overflow
    key[mine] = (max(key.max(), 0) + 1) if found.dtype == object else np.iinfo(found.dtype).max
    edge = np.partition(key, k - 1, axis=1)[:, k - 1] if found.shape[1] > k else key.max(axis=1)
    rows, cols = np.nonzero((key <= edge[:, None]) & ~mine)
    tie = key[rows, cols] == edge[rows]
    sure = np.bincount(rows[~tie], minlength=len(found))
    tied = rows[tie]
    nth = np.arange(len(tied)) - np.searchsorted(tied, np.arange(len(found)))[tied]  # among the row's ties, by id
    keep = np.ones(len(rows), bool)
    keep[tie] = nth < (k - sure)[tied]
    return rows[keep], cols[keep]


def meet(table: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the k best candidates of each query of a block (asks, id, weights) of both sides."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    table = table.sort_by("id")
    asks = table.column("asks").to_numpy()
    if asks.all() or not asks.any():
        return out.empty_table()
    asking, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    q_ids, ids = asking.column("id").to_numpy(), others.column("id").to_numpy()
    queries, candidates = (Sparse(t.column("weights").combine_chunks()) for t in (asking, others))
    kind = width(queries.norm() * candidates.norm())
    held = candidates.postings(kind)
    parts = []
    for a in range(0, len(q_ids), _SELECTED):
        own = q_ids[a : a + _SELECTED]
        found = scores(queries.part(a, a + len(own)), held, len(ids), kind)
        r, c = best(found, own, ids, k)
        score = found[r, c]
        if kind is object and len(score) and max(map(abs, score)) >= 1 << 63:
            raise ArithmeticError("a score does not fit in a long")
        parts.append((own[r], ids[c], score.astype(np.int64)))
    return pa.table([np.concatenate(x) for x in zip(*parts, strict=True)], schema=out)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    finite = ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda x: F.when(F.abs(x) < float(1 << 63), F.floor(x)).otherwise(F.raise_error(F.lit("a component does not fit in a long")).cast("long"))
    weights = F.transform(F.col(vector_col), lambda x: whole(scale * x.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), weights.alias("weights")).distinct()
    rows = saved(rows, "vectors")
    is_query = F.pmod("id", F.lit(every)) == 0
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    # at least as many candidate blocks as there are cores to keep busy
    c_blocks = max(1, -(-n // candidate_block), min(2 * spark.sparkContext.defaultParallelism, n // (8 * k)))
    q_blocks = max(1, -(-asked // query_block))
    block = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every_block = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.where(is_query).select(block(q_blocks, 1).alias("q"), every_block(c_blocks).alias("c"), F.lit(True).alias("asks"), "id", "weights")
    right = rows.select(every_block(q_blocks).alias("q"), block(c_blocks, 2).alias("c"), F.lit(False).alias("asks"), "id", "weights")
    met = left.unionByName(right).groupBy("q", "c").applyInArrow(lambda _, table: meet(table, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: rows of embeddings whose vec_id is divisible by 20, against all rows."""
    return top_k(load(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
