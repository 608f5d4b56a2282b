"""PCA whitening of vectors by a tiled covariance.

Components become whole numbers x = floor(scale * c) + shift. Dimensions are cut into blocks of TILE columns, and each
pair of column blocks is a tile. A map task packs ROWS rows at a time, less a whole number near each dimension's mean,
into one binary value for each column block, in the narrowest type that holds them. These column blocks are shuffled by
row block and tile, each pair is multiplied there, and the products are summed for each tile over the row blocks. The
driver assembles the covariance matrix and decomposes it; the basis goes back to the workers as a broadcast.

Exactness: the packed rows are whole numbers, so sums and products are whole numbers, summed in limbs of 32 bits and
corrected for the rest of the mean in Python's integers. Every entry of the covariance is therefore the double nearest to
its true value, in whatever order tasks run. A product block takes float64 where 53 bits hold its sums, else int64, else
whole numbers of any size.

Scale: nothing of a row is sent to the driver. A task holds one row block (ROWS rows) or one pair of column blocks;
each row travels once for each column block of the other side, that is dimensions / TILE times, packed. The driver gets
one number for each pair of dimensions whatever the number of rows; more than MAX_DIMENSIONS are refused. Rows are read
from a table of whole numbers that is written once, so a lost executor costs a re-read. Workers get the basis,
8 * dimensions * components bytes.

Cases: a vector that is null or holds a null or non-finite component takes no part. A missing component of a vector
shorter than the longest is 0. Every row counts, also if id or vector repeat; a null id stays null. Components whose
eigenvalue is below EIGEN_FLOOR of the largest have no direction that doubles can tell, and are left out: constant
dimensions and fewer rows than dimensions give fewer components, one row or equal rows give none, and no rows. A
component beyond 2^61 is refused with an error (ArithmeticError in the task), never wrapped. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load, saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Columns of a column block and rows of a row block.
TILE = 32
ROWS = 8192
#: Dimensions of which the driver takes the matrix (a row for each of two million pairs at the most).
MAX_DIMENSIONS = 2048
#: The least eigenvalue of a component, as a share of the largest.
EIGEN_FLOOR = 1e-10
_LIMB = (1 << 32) - 1
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of the vectors that take part."""
    c = F.col(vector_col)
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = lambda x: scale * x.cast("double")
    x = F.transform(c, lambda x: F.when(F.abs(scaled(x)) < float(1 << 61), F.floor(scaled(x)) + shift).otherwise(F.raise_error(F.lit("a component does not fit in a long")).cast("long")))
    return vectors.where(c.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))


def _matrix(lists: pa.Array, width: int, fill: int) -> np.ndarray:
    """The lists as rows of `width` numbers; missing ones are `fill`."""
    size = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.full((len(size), width), fill, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x in a type in which `factor` times its largest number does not overflow."""
    return x if _most(x) * factor < 1 << 62 else x.astype(object)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Three columns of longs that add up to x = low + middle * 2^32 + high * 2^64, however many rows are added."""
    if x.dtype == object:
        return [np.array([f(int(v)) for v in x], np.int64) for f in (lambda v: v & _LIMB, lambda v: (v >> 32) & _LIMB, lambda v: v >> 64)]
    return [x & _LIMB, x >> 32, np.zeros(len(x), np.int64)]


_LIMBS = "low long, middle long, high long"


def _value(r) -> int:
    return r.low + (r.middle << 32) + (r.high << 64)


def totals(rows: DataFrame, shift: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension; a missing component counts as `shift`."""

    def run(batches):
        n, total, there = 0, np.zeros(0, object), np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column(0)
            size = np.diff(np.asarray(lists.offsets))
            width = int(size.max(initial=0))
            if width > len(total):
                total, there = (np.concatenate((x, np.zeros(width - len(x), x.dtype))) for x in (total, there))
            own = _matrix(lists, width, 0)
            total[:width] += _exact(own, max(1, len(own))).sum(axis=0).astype(object)
            there += (size[:, None] > np.arange(len(there))).sum(axis=0)
            n += len(own)
        if n:  # as dimension -1 the number of rows
            yield pa.record_batch([pa.array(np.arange(-1, len(total))), *map(pa.array, _limbs(np.concatenate(([0], total)))), pa.array(np.concatenate(([n], there)))], names=["dim", "low", "middle", "high", "there"])

    found = rows.select("x").mapInArrow(run, f"dim long, {_LIMBS}, there long")
    by = {r.dim: r for r in found.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("low", "middle", "high", "there")]).collect()}  # one row for each dimension
    n = by[-1].there if by else 0
    return n, [_value(by[i]) + (n - by[i].there) * shift for i in range(len(by) - 1)]


def tiled(packed: DataFrame, columns: int, tile: int) -> DataFrame:
    """Sums over all rows of the products of each pair of columns i <= j, of packed column blocks (block, part, kind, rows, data).

    Whole numbers come as limbs, others as `product`, which is a double.
    """
    parts = -(-columns // tile)
    others = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b"))))
    dealt = packed.withColumn("tile", others).select("block", "tile.a", "tile.b", "part", "kind", "rows", "data")

    def multiply(table: pa.Table) -> pa.Table:
        r = table.sort_by("part").to_pylist()
        left, right = (np.frombuffer(x["data"], x["kind"]).reshape(x["rows"], -1) for x in (r[0], r[-1]))
        i, j = (np.arange(m.shape[1]) + tile * x["part"] for m, x in ((left, r[0]), (right, r[-1])))
        whole_numbers = left.dtype.kind == "i"
        if whole_numbers:
            bound = _most(left) * _most(right) * len(left)
            kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
            product = left.astype(kind).T @ right.astype(kind)
            product = product if kind is object else product.astype(np.int64)
        else:
            product = left.T @ right
        keep = i[:, None] <= j[None, :]
        at = np.nonzero(keep)
        values = product[at]
        limbs = _limbs(values) if whole_numbers else [np.zeros(len(values), np.int64)] * 3
        return pa.table([i[at[0]], j[at[1]], *limbs, np.zeros(len(values)) if whole_numbers else values], names=["i", "j", "low", "middle", "high", "product"])

    met = dealt.groupBy("block", "a", "b").applyInArrow(multiply, f"i long, j long, {_LIMBS}, product double")
    return met.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("low", "middle", "high", "product")])


def _packed(rows: DataFrame, matrices, tile: int, block_rows: int) -> DataFrame:
    """The matrices that matrices(batch of x) gives, cut into row blocks and column blocks."""

    def blocks(batches) -> Iterator[np.ndarray]:
        held, size = [], 0
        for batch in batches:
            own = matrices(batch.column(0))
            while len(own):
                held.append(own[: block_rows - size])
                size += len(held[-1])
                own = own[len(held[-1]) :]
                if size == block_rows:
                    yield np.concatenate(held)
                    held, size = [], 0
        if size:
            yield np.concatenate(held)

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for k, x in enumerate(blocks(batches)):
            for part, at in enumerate(range(0, x.shape[1], tile)):
                own = x[:, at : at + tile]
                if own.dtype.kind == "i":
                    own = own.astype(next(t for t in _KINDS if _most(own) <= np.iinfo(t).max))
                yield pa.record_batch([pa.array([task + k]), pa.array([part], pa.int32()), pa.array([own.dtype.str]), pa.array([len(own)]), pa.array([np.ascontiguousarray(own).tobytes()], pa.binary())], names=["block", "part", "kind", "rows", "data"])

    return rows.select("x").mapInArrow(run, "block long, part int, kind string, rows long, data binary")


@dataclass
class Whitening:
    """What fit() found: the exact sums of n rows and the components, largest eigenvalue first."""

    n: int
    sums: list[int]
    pivot: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    shift: int
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        """Each component's share of the variance of all dimensions."""
        return [float(e / np.trace(self.covariance)) for e in self.values]

    def _project(self):
        """A function from lists of x to whitened rows."""
        width, shift, pivot, mean = len(self.sums), self.shift, self.pivot, self.rest.astype(np.float64) / max(1, self.n)
        scaled = self.basis / np.sqrt(self.values)
        return lambda lists: ((_matrix(lists, width, shift) - pivot) - mean) @ scaled

    def transform(self, rows: DataFrame) -> DataFrame:
        """(id, deviation decimal(38,0), whitened array<double>) of rows (id, x).

        deviation is the sum of (n * x - sum)^2 over the dimensions; null if it has more than 38 digits.
        """
        project, n, width, shift, pivot, rest = self._project(), self.n, len(self.sums), self.shift, self.pivot, self.rest
        kind = pa.decimal128(38, 0)

        def run(batches):
            for batch in batches:
                lists = batch.column(1)
                y = _matrix(lists, width, shift) - pivot
                room = (n * _most(y) + _most(rest)) ** 2 * max(1, width) < 1 << 63
                apart = n * (y if room else y.astype(object)) - (rest if room else rest.astype(object))
                square = (apart * apart).sum(axis=1)
                far = pa.array(square.astype(np.int64)).cast(kind) if room else pa.array([int(v) if abs(int(v)) < 10**38 else None for v in square], kind)
                w = project(lists)
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.record_batch([batch.column(0), far, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

        # the schema's own type of id; a Python worker gets the basis with its function
        return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS, shift: int = SHIFT, tile: int = TILE, block_rows: int = ROWS) -> Whitening:
    """The whitening of rows (id, x); rows must be a stored table, as it is read four times."""
    n, sums = totals(rows, shift)
    d = len(sums)
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions, more than {MAX_DIMENSIONS}")
    pivot = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the whole number nearest to the mean
    rest = np.array([s - n * int(m) for s, m in zip(sums, pivot, strict=True)], np.int64)
    covariance = np.zeros((d, d))
    if d:
        centred = lambda lists: _matrix(lists, d, shift) - pivot
        for r in tiled(_packed(rows, centred, tile, block_rows), d, tile).collect():  # one row for each pair of dimensions
            covariance[r.i, r.j] = covariance[r.j, r.i] = (n * _value(r) - int(rest[r.i]) * int(rest[r.j])) / (n * n)
    values, basis = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    values, basis = values[::-1], basis[:, ::-1]
    k = int((values[:components] > EIGEN_FLOOR * values.max(initial=0.0)).sum())
    values, basis = values[:k], basis[:, :k]
    if k:  # either sign would do; the largest entry of a component is positive
        basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(k)])
    out = Whitening(n, sums, pivot, rest, covariance, values, basis, shift)
    if k:
        out.identity_error = _identity_error(rows, out, tile, block_rows)
    return out


def _identity_error(rows: DataFrame, found: Whitening, tile: int, block_rows: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity, measured over all rows."""
    project, n, k = found._project(), found.n, len(found.values)

    def run(batches):
        total = sum((project(b.column(0)).sum(axis=0) for b in batches), np.zeros(k))
        yield pa.record_batch([pa.array(np.arange(k)), pa.array(total)], names=["dim", "total"])

    sums = rows.select("x").mapInArrow(run, "dim long, total double").groupBy("dim").agg(F.sum("total").alias("total")).collect()  # one row for each component
    mean = np.array([r.total for r in sorted(sums)]) / n
    apart = 0.0
    for r in tiled(_packed(rows, lambda lists: project(lists) - mean, tile, block_rows), k, tile).collect():  # one row for each pair of components
        apart = max(apart, abs(r.product / n - (r.i == r.j)))
    return float(apart)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE, block_rows: int = ROWS) -> tuple[Whitening, DataFrame]:
    """The whitening that is fitted to all vectors, and (id, deviation, whitened) of each of them."""
    rows = saved(whole(vectors, id_col, vector_col, scale, shift), "vectors")
    found = fit(rows, components, shift, tile, block_rows)
    return found, found.transform(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector of embeddings; deviation is null where a long does not hold it."""
    found, rows = whiten(load(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(x) for x in found.explained]).cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(found.identity_error).cast("double").alias("identity_error"),
    )
