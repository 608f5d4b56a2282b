"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights of the cells (source, language, topic) are raked to three marginals at once: each marginal's targets are
shares of all tokens, by default the measured shares to the power TEMPER (so large categories give room to small ones)
or the shares a caller states; categories that a caller's targets leave out share what these leave of 1, in proportion
to their tempered shares. Documents are then sampled with a probability proportional to their cell's weight, by a hash
of doc_id and text, so a decision depends on neither order nor partitions. Probabilities are scaled so that RETAIN of
all tokens stay in expectation, or another stated budget; those that would exceed 1 are capped there and the rest is
scaled up for it, so the rarest cells are kept whole and stay below their targets, which column ``capped`` tells. With
budget None the largest budget is taken at which no probability exceeds 1, where the expected shares equal the targets;
the single rarest cell then sets how much of the corpus stays. Column ``raking_gap`` is the largest relative distance
of a category's raked share from its target: near 0 if raking has converged, larger if ROUNDS rounds did not suffice or
if the marginals contradict each other, in which case topics are met exactly, being raked last.

Topic: one of TOPICS clusters of hashed terms, ``topic0`` being the largest in the sample, or ``empty`` for a text
without words. A text is a vector of its words' counts in TERMS places, (1 + log count) times the place's inverse
document frequency, scaled to length 1, less its language's mean, so that topics are not languages. Frequencies, means
and centres are those of all distinct texts (copies count once): centres by spherical k-means, of TOPIC_ROUNDS rounds at
most, each over all of them. Nothing is sampled for it; sums are of whole numbers, so they depend on no order.

Scale: one pass over all texts writes the vectors of the distinct ones (6 bytes a term), which are shuffled once by hash;
each round reads them in as many tasks as keep the cluster busy, and their TOPICS * TERMS sums and those of their
languages are folded by tasks until the driver gets DIRECT of them at most. Languages beyond MEANS are worked on in blocks of so many, so the driver holds one block's means. One pass over all texts finds
topic and tokens of each row and writes them with what is kept of the row, so the
sums by cell (partial ones first) and the result don't read texts again. No category is capped or lumped. Up to
LOCAL_CELLS cells (some 100 bytes each) are collected and raked on the driver; more are raked in Spark by sums over
the cells, to the same weights. Cells are joined back by broadcast up to BROADCAST_CELLS and by shuffle beyond.

Cases: null and blank texts have 0 tokens and are sampled like their cell; null source and lang are categories of their
own, apart from the empty string. Equal rows share one decision. A cell without tokens gets the product of its
categories' factors as its weight. Empty tables give no rows. Clashing column names are kept apart by a struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._spark import dropped, lean, load, quoted, saved, writing
from ._text import chunks, word_hashes
from ._text import mix as hash_mix

TEMPER = 0.8
#: Share of all tokens that is kept in expectation.
RETAIN = 0.9
ROUNDS = 60
CLOSE = 1e-9
TOPICS = 8
TERMS = 4096
TOPIC_ROUNDS = 25
#: A centre that moves less is at rest.
AT_REST = 1e-3
#: Terms that are worked on at once in a round.
PACK = 1 << 16
#: Draws among which a first centre is chosen.
DRAWS = 4
#: Sums over texts are sums of whole parts of 1 / PART, so they depend on no order.
PART = 1 << 24
#: The squared length below which a text is its language's mean, and the distance below which it is a centre.
LEAST = 1e-6
#: Languages whose means (16 KB each) are held at once; more are taken in turn.
MEANS = 1024
#: Results of tasks that the driver takes from a pass over all texts, a few hundred KB each; more are folded by tasks first.
DIRECT = 64
#: Texts that a task knows as copies at once; what it meets again later is found in the shuffle.
MOST_SEEN = 1_000_000
LOCAL_CELLS = 1_000_000
BROADCAST_CELLS = 100_000
SEED = 20240607
CELL = ("source", "lang", "topic")


def terms(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, 1 + log count) of the hashed terms of each row, and the rows' numbers of words."""
    hashes, first = word_hashes(off, data)
    n = np.diff(first)
    key = np.repeat(np.arange(len(n), dtype=np.int64) * TERMS, n) + (hashes >> np.uint64(52)).astype(np.int64) % TERMS
    if len(n) * TERMS <= 16 * len(key):
        count = np.bincount(key, minlength=1)
        key = np.flatnonzero(count)
        count = count[key]
    else:
        key, count = np.unique(key, return_counts=True)
    return key // TERMS, key % TERMS, 1 + np.log(count), n


def distinct_terms(rows: DataFrame) -> DataFrame:
    """(hash, lang, places, values) of every distinct text, written once; of copies in several languages the least counts."""
    hashed = rows.where("text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))

    def run(batches):
        seen = set()
        for batch in batches:
            langs, hashes = batch.column("lang").to_pylist(), batch.column("hash").to_pylist()
            for a, off, data in chunks(batch.column("text")):
                out = []
                row, place, value, _ = terms(off, data)
                edges = np.searchsorted(row, np.arange(len(off)))
                for i in range(len(off) - 1):
                    own = hashes[a + i], langs[a + i]
                    if own not in seen:
                        seen.add(own)
                        x, y = edges[i], edges[i + 1]
                        out.append((*own, place[x:y].astype("<u2").tobytes(), value[x:y].astype("<f4").tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["hash", "lang", "places", "values"])
                if len(seen) > MOST_SEEN:
                    seen.clear()

    found = hashed.mapInArrow(lean(run), "hash long, lang string, places binary, values binary")
    return saved(found.groupBy("hash").agg(F.min("lang").alias("lang"), F.first("places").alias("places"), F.first("values").alias("values")), "terms")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values, end to end, of a column of arrays held as bytes."""
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(kind)
    return (off - off[0]) // flat.itemsize, flat


def _units(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the vectors of a batch, each scaled to length 1."""
    off, place = _flat(batch.column("places"), "<u2")
    row = np.repeat(np.arange(batch.num_rows), np.diff(off))
    w = _flat(batch.column("values"), "<f4")[1] * idf[place]
    return row, place, w / np.sqrt(np.bincount(row, weights=w * w, minlength=batch.num_rows))[row]


def passed(rows: DataFrame, run, schema: str, fold) -> list:
    """What run() gives for rows, on the driver: each task gives a few rows, however many it reads.

    There are as many tasks as keep the cluster busy. What more than DIRECT of them give is folded by DIRECT tasks to as
    many rows of the same kind: fold() takes rows and gives fewer that stand for them.
    """
    n = 2 * rows.sparkSession.sparkContext.defaultParallelism
    with writing(rows.sparkSession):
        if n <= DIRECT:
            return rows.coalesce(n).mapInArrow(lean(run), schema).collect()

        kinds = to_arrow_schema(T.StructType.fromDDL(schema)).types

        def folded(batches):
            held = [r for batch in batches for r in batch.to_pylist()]
            if held:
                names = list(held[0])
                out = fold(held)
                yield pa.record_batch([pa.array([r[c] for r in out], kind) for c, kind in zip(names, kinds, strict=True)], names=names)

        return rows.coalesce(4 * n).mapInArrow(lean(run), schema).repartition(max(1, DIRECT)).mapInArrow(lean(folded), schema).collect()


def _added(rows: list[dict]) -> list[dict]:
    """One row of the sums of arrays of longs, held as bytes."""
    return [{c: sum((np.frombuffer(r[c], np.int64) for r in rows[1:]), np.frombuffer(rows[0][c], np.int64)).tobytes() for c in rows[0]}]


def place_counts(found: DataFrame) -> np.ndarray:
    """The number of texts by place, and of all texts at the end."""

    def run(batches):
        held = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                held[:TERMS] += np.bincount(_flat(batch.column("places"), "<u2")[1], minlength=TERMS)
                held[TERMS] += batch.num_rows
        yield pa.record_batch([pa.array([held.tobytes()], pa.binary())], names=["held"])

    return sum((np.frombuffer(r.held, np.int64) for r in passed(found.select("places"), run, "held binary", _added)), np.zeros(TERMS + 1, np.int64))


def language_sums(found: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, place, total): sums of the unit vectors of each language's texts in parts of 1 / PART, and at place TERMS
    the number of its texts with a word; written once."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for name, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "place", "total"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            row, place, u = _units(batch, idf)
            code = batch.column("lang").dictionary_encode()
            names, own = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
            some = np.bincount(own[np.unique(row)], minlength=len(names))
            at = own[row].astype(np.int64) * TERMS + place
            key, at = (np.arange(len(names) * TERMS), at) if len(names) <= 64 else np.unique(at, return_inverse=True)
            total = np.bincount(at, weights=np.rint(u * PART), minlength=len(key)).astype(np.int64)
            edges = np.searchsorted(key, np.arange(len(names) + 1) * TERMS)
            for i, name in enumerate(names):
                if some[i]:
                    sums = held.setdefault(name, np.zeros(TERMS + 1, np.int64))
                    sums[key[edges[i] : edges[i + 1]] % TERMS] += total[edges[i] : edges[i + 1]]
                    sums[TERMS] += some[i]
                if len(held) >= MEANS:
                    yield from out()
        yield from out()

    parts = found.select("lang", "places", "values").mapInArrow(lean(run), "lang string, place int, total long")
    return saved(parts.groupBy("lang", "place").agg(F.sum("total").alias("total")), "means")


_PACKED = ("hashes", "langs", "inverses", "sizes", "places", "values")
_KINDS = ("<i8", "<i4", "<f8", "<i4", "<u2", "<f4")


def _opened(batches):
    """(hashes, language numbers, inverses, offsets, places, values) of the texts of each packed row."""
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, lang, inverse, sizes, place, u = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(_PACKED, _KINDS, strict=True))
            yield hashes, lang, inverse, np.concatenate(([0], np.cumsum(sizes))), place, u


class Block:
    """Texts of up to MEANS languages, less their languages' means: packed rows of about PACK terms, of unit vectors before
    and the inverse of the length after; texts that equal their mean are left out."""

    def __init__(self, found: DataFrame, sums: DataFrame, names: list[str], idf: np.ndarray, alone: bool):
        self.names, self._sums, self._held = names, sums, None
        means = self.means()
        self._held = means if alone else None
        model, value_set = found.sparkSession.sparkContext.broadcast(means.astype(np.float32)), pa.array(names, pa.string())

        def run(batches):
            m = model.value
            squares = (m.astype(float) ** 2).sum(axis=1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, place, u = _units(batch, idf)
                n, own = batch.num_rows, pc.index_in(batch.column("lang"), value_set=value_set).fill_null(0).to_numpy(zero_copy_only=False)
                size = np.bincount(row, minlength=n)
                left = 1 - 2 * np.bincount(row, weights=u * m[own[row], place], minlength=n) + squares[own]
                fine = (left > LEAST) & (size > 0)
                inside = fine[row]
                place, u, ends = place[inside], u[inside], np.concatenate(([0], np.cumsum(size[fine])))
                of_text = batch.column("hash").to_numpy()[fine], own[fine], left[fine] ** -0.5, size[fine]
                cuts = np.unique(np.searchsorted(ends, np.append(np.arange(0, ends[-1], PACK), ends[-1])))
                rows = [[*(x[a:b] for x in of_text), place[ends[a] : ends[b]], u[ends[a] : ends[b]]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([pa.array([r[c].astype(kind).tobytes() for r in rows], pa.binary()) for c, kind in enumerate(_KINDS)], names=list(_PACKED))

        own = found if alone else found.where(F.col("lang").between(names[0], names[-1]))
        self.texts = saved(own.select("hash", "lang", "places", "values").mapInArrow(lean(run), ", ".join(f"{c} binary" for c in _PACKED)), "vectors", compression="none")

    def means(self) -> np.ndarray:
        """The mean of the unit vectors of each language."""
        if self._held is not None:
            return self._held
        table = self._sums.where(F.col("lang").between(self.names[0], self.names[-1])).toArrow()  # 16 MB or so for MEANS languages
        out = np.zeros((len(self.names), TERMS + 1))
        out[pc.index_in(table.column("lang"), value_set=pa.array(self.names, pa.string())).to_numpy(), table.column("place").to_numpy()] = table.column("total").to_numpy()
        return out[:, :TERMS] / PART / out[:, TERMS:]

    def vector(self, row) -> np.ndarray:
        """The centred unit vector of a row that seeds() drew."""
        out = -self.means()[row.lang]
        out[np.frombuffer(row.places, "<u2")] += np.frombuffer(row.values, "<f4")
        return out * row.inverse

    def compared(self, c: np.ndarray):
        """A function of some texts (language numbers, inverses, offsets, places, values): their cosines to each of c."""
        offsets, flat = self.means() @ c.T, c.astype(np.float32)

        def of(lang, inverse, off, place, u):
            at = place.astype(np.intp)
            near = np.array([np.add.reduceat(own.take(at) * u, off[:-1]) for own in flat]).reshape(len(flat), -1).T if len(flat) else np.zeros((len(lang), 0))
            return (near - offsets[lang]) * inverse[:, None]

        return of


def _first(rows: list[dict]) -> list[dict]:
    """Of rows (t, s, time, hash, ...) the first of each draw, and the sum of the times of s = -1."""
    out: dict = {}
    for r in rows:
        at = r["t"], r["s"]
        if at not in out:
            out[at] = dict(r)
        elif r["s"] < 0:
            out[at]["time"] += r["time"]
        elif (r["time"], r["hash"]) < (out[at]["time"], out[at]["hash"]):
            out[at] = r
    return list(out.values())


def seeds(blocks: list[Block], k: int) -> np.ndarray:
    """k of the texts' centred vectors to begin with: each is drawn from all texts by its distance from those before (a race
    of draws by hash), DRAWS times, and the draw that leaves the least sum of distances is taken."""
    chosen, tried = np.zeros((0, TERMS)), np.zeros((0, TERMS))
    while len(chosen) < k:
        won, left = {}, np.zeros(max(1, len(tried)), object)
        for block in blocks:
            compare, m = block.compared(np.concatenate([chosen, tried])), len(chosen)
            salts = np.arange(1, DRAWS + 1, dtype=np.uint64) + np.uint64(DRAWS * (m + bool(len(tried))))

            def run(batches, compare=compare, m=m, salts=salts, draws=len(left)):
                best, total = {}, [0] * draws
                for hashes, *texts in _opened(batches):
                    lang, inverse, off, place, u = texts
                    near = compare(*texts)
                    with np.errstate(over="ignore"):
                        race = -np.log(((hash_mix(hashes.view(np.uint64)[:, None] ^ hash_mix(salts)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
                    far = 1 - near[:, :m].max(axis=1, initial=-1)
                    for t in range(draws):
                        d = np.clip(np.minimum(far, 1 - near[:, m + t]), 0, 2) if near.shape[1] > m else np.ones(len(far))
                        total[t] += int(np.rint(d * PART).sum())
                        time = np.where((d > LEAST)[:, None], race / np.maximum(d, LEAST)[:, None], np.inf)
                        for s, first in enumerate(time.min(axis=0).tolist()):
                            if first < np.inf and first <= best.get((t, s), (np.inf,))[0]:
                                same = np.flatnonzero(time[:, s] == first)
                                i = same[np.argmin(hashes[same])]
                                own = slice(off[i], off[i + 1])
                                best[t, s] = min(best.get((t, s), (np.inf,)), (first, int(hashes[i]), int(lang[i]), float(inverse[i]), place[own].tobytes(), u[own].tobytes()))
                rows = [(t, -1, float(total[t]), 0, None, None, None, None) for t in range(draws)] + [(t, s, *w) for (t, s), w in best.items()]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["t", "s", "time", "hash", "lang", "inverse", "places", "values"])

            for r in passed(block.texts, run, "t int, s int, time double, hash long, lang int, inverse double, places binary, values binary", _first):
                if r.s < 0:
                    left[r.t] += int(r.time)
                elif (r.t, r.s) not in won or (r.time, r.hash) < won[r.t, r.s][0]:
                    won[r.t, r.s] = (r.time, r.hash), block, r
        t = int(np.argmin(left))
        if len(tried):
            chosen = np.concatenate([chosen, tried[t : t + 1]])
        drawn = {r.hash: block.vector(r) for (own, _), (_, block, r) in sorted(won.items(), key=lambda x: x[0]) if own == t}
        if not drawn:
            break
        tried = np.array(list(drawn.values()))
    return chosen


def assigned(blocks: list[Block], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the centred unit vectors of all texts that are nearest to each centre, and the numbers of these texts."""
    k, sums, sizes = len(c), np.zeros(c.shape), np.zeros(len(c), np.int64)
    for block in blocks:
        compare, langs = block.compared(c), len(block.names)

        def run(batches, compare=compare, langs=langs):
            held, lengths, sizes = np.zeros(k * TERMS, np.int64), np.zeros(langs * k, np.int64), np.zeros(k, np.int64)
            for _, *texts in _opened(batches):
                lang, inverse, off, place, u = texts
                own, n = np.argmax(compare(*texts), axis=1), np.diff(off)
                held += np.bincount(np.repeat(own * TERMS, n) + place, weights=np.rint(u * np.repeat(inverse * PART, n)), minlength=k * TERMS).astype(np.int64)
                lengths += np.bincount(lang * k + own, weights=np.rint(inverse * PART), minlength=langs * k).astype(np.int64)
                sizes += np.bincount(own, minlength=k)
            yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (held, lengths, sizes)], names=["held", "lengths", "sizes"])

        held, lengths = np.zeros(k * TERMS, np.int64), np.zeros(langs * k, np.int64)
        for r in passed(block.texts, run, "held binary, lengths binary, sizes binary", _added):
            held += np.frombuffer(r.held, np.int64)
            lengths += np.frombuffer(r.lengths, np.int64)
            sizes += np.frombuffer(r.sizes, np.int64)
        sums += held.reshape(k, TERMS) / PART - (lengths.reshape(langs, k).T / PART) @ block.means()
    return sums, sizes


def centres(blocks: list[Block], k: int, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """k unit centres of all texts by spherical k-means; the largest cluster first."""
    c = seeds(blocks, k)
    if not len(c):
        return c
    for _ in range(rounds):
        sums, _ = assigned(blocks, c)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        before, c = c, np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        if np.linalg.norm(c - before, axis=1).max() < AT_REST:
            break
    return c[np.argsort(-assigned(blocks, c)[1], kind="stable")]


def topic_model(rows: DataFrame, topics: int = TOPICS) -> dict:
    """idf by place, centres, and what each language's mean takes off each centre's score; rows: (lang, text)."""
    found = distinct_terms(rows)
    *counts, n = place_counts(found)
    idf = (np.log((1 + n) / (1 + np.array(counts))) + 1).astype(np.float32)
    sums = language_sums(found, idf)
    names = sorted(r.lang for r in sums.where(F.col("place") == TERMS).select("lang").collect())  # as many as languages
    blocks = [Block(found, sums, names[a : a + MEANS], idf, len(names) <= MEANS) for a in range(0, len(names), MEANS)]
    dropped(found)
    c = centres(blocks, topics).astype(np.float32)
    means = {name: own for block in blocks for name, own in zip(block.names, (block.means() @ c.T).astype(np.float32), strict=True)}
    dropped(sums, *(block.texts for block in blocks))
    return {"idf": idf, "centres": c, "means": means}


def topics_of(model: dict, off: np.ndarray, data: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(topic number or -1, words) of each row."""
    row, place, value, words = terms(off, data)
    c, n = model["centres"], len(off) - 1
    if not len(c):
        return np.where(words > 0, 0, -1), words
    w = value * model["idf"][place]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
    none = np.zeros(len(c), np.float32)
    score = np.stack([np.bincount(row, weights=w * c[j][place], minlength=n) for j in range(len(c))], axis=1) / np.maximum(norm, 1e-12)[:, None]
    score -= np.stack([model["means"].get(name, none) for name in langs]) if n else 0
    return np.where(words > 0, np.argmax(score, axis=1), -1), words


def celled(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, lang_col: str, seed: int, topics: int) -> DataFrame:
    """(row, source, lang, topic, tokens, draw) of every row, written once; source and lang are "=" and the value or "" for null."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    inside = text_col in keep
    text = F.col(text_col)
    rows = docs.select(F.struct(*map(quoted, keep)).alias("row"), key(source_col).alias("source"), key(lang_col).alias("lang"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("draw"), *([] if inside else [text.alias("text")]))
    model = docs.sparkSession.sparkContext.broadcast(topic_model(docs.select(key(lang_col).alias("lang"), text.alias("text")), topics))

    def run(batches):
        fitted = model.value
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for a, off, data in chunks(pc.struct_field(batch.column("row"), [batch.column("row").type.get_field_index(text_col)]) if inside else batch.column("text")):
                own = batch.slice(a, len(off) - 1)
                topic, words = topics_of(fitted, off, data, names[a : a + len(off) - 1])
                yield pa.record_batch([own.column("row"), own.column("source"), own.column("lang"), pa.array(["empty" if t < 0 else f"topic{t}" for t in topic], pa.string()), pa.array(words, pa.int64()), own.column("draw")], names=["row", "source", "lang", "topic", "tokens", "draw"])

    kinds = [rows.schema["row"], *(T.StructField(c, T.StringType()) for c in CELL), T.StructField("tokens", T.LongType()), T.StructField("draw", T.LongType())]
    return saved(rows.mapInArrow(lean(run), T.StructType(kinds)), "celled")


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Weights by cell whose weighted mass has the target shares in every marginal, 1 being the unweighted mass, and the
    largest relative distance of a share from its target that is left."""
    weight = np.ones(len(mass))
    total = max(mass.sum(), 1e-300)

    def factors():
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights=mass * weight, minlength=len(target)) / total
            yield code, np.divide(target, now, out=np.ones(len(target)), where=now > 0), (now > 0) & (target > 0)

    gap = 0.0
    for _ in range(rounds):
        gap = 0.0
        for code, factor, told in factors():
            gap = max(gap, float(np.abs(1 / factor[told] - 1).max(initial=0)))
            weight = weight * factor[code]
        if gap < close:
            return weight, gap
    return weight, max((float(np.abs(1 / factor[told] - 1).max(initial=0)) for _, factor, told in factors()), default=gap)


def scale_for(kept, weights: tuple[float, float], budget: float | None, steps: int = 200) -> float:
    """The factor of weights (least, largest) at which kept(factor), the expected share of all mass, is the budget."""
    least, largest = weights
    if budget is None or largest <= 0:
        return 1 / max(largest, 1e-300)
    low, high = 0.0, 1 / max(least, 1e-300)
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if kept(middle) < budget else (low, middle)
        if high - low <= 1e-12 * high:
            break
    return (low + high) / 2


def wanted(share: dict[str, float], stated: dict[str | None, float] | None, temper: float) -> dict[str, float]:
    """Target shares by category key of measured masses, summing to 1."""
    out = {k: v**temper if v > 0 else 0.0 for k, v in share.items()}
    if stated is not None:
        told = {k: float(stated[v]) for k in share if share[k] > 0 and (v := None if k == "" else k.removeprefix("=")) in stated}
        rest = max(0.0, 1 - sum(told.values()))
        free = sum(v for k, v in out.items() if k not in told)
        out = {k: told.get(k, v * rest / free if free else 0.0) for k, v in out.items()}
    total = sum(out.values())
    return {k: v / total if total else 0.0 for k, v in out.items()}


def raked_locally(cells: DataFrame, targets: dict, temper: float, budget: float | None) -> tuple[pa.Table, float]:
    """(source, lang, topic, weight, probability, capped) of cells (…, mass), and the gap; on the driver."""
    table = cells.toArrow().sort_by([(c, "ascending") for c in CELL])
    mass = np.asarray(table.column("mass").to_numpy(), float)
    codes, aims = [], []
    for c in CELL:
        found = table.column(c).combine_chunks().dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False)
        names = found.dictionary.to_pylist()
        aim = wanted(dict(zip(names, np.bincount(code, weights=mass, minlength=len(names)).tolist(), strict=True)), targets.get(c), temper)
        codes.append(code)
        aims.append(np.array([aim[k] for k in names]))
    weight, gap = rake(mass, codes, aims)
    held, total = mass > 0, max(mass.sum(), 1e-300)
    own = weight[held & (weight > 0)]
    scale = scale_for(lambda s: (np.minimum(1, weight * s) * mass).sum() / total, (own.min(initial=np.inf), own.max(initial=0)), budget)
    return pa.table({**{c: table.column(c) for c in CELL}, "weight": weight, "probability": np.minimum(1, weight * scale), "capped": weight * scale > 1 + 1e-9}), gap


def raked_in_spark(cells: DataFrame, targets: dict, temper: float, budget: float | None, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """As raked_locally(), by sums over the cells; nothing but a few numbers reaches the driver."""
    total = cells.agg(F.sum("mass")).first()[0] or 1e-300
    cells = cells.withColumn("weight", F.lit(1.0))
    aims = {}
    for c in CELL:
        share = cells.groupBy(c).agg(F.sum("mass").alias("mass")).withColumn("aim", F.when(F.col("mass") > 0, F.pow("mass", F.lit(temper))).otherwise(0.0))
        if (stated := targets.get(c)) is not None:
            told = cells.sparkSession.createDataFrame([("" if k is None else k if c == "topic" else f"={k}", float(v)) for k, v in stated.items()], f"{c} string, told double")
            share = saved(share.join(told, c, "left").withColumn("told", F.when(F.col("mass") > 0, F.col("told"))), "share")
            sums = share.agg(F.coalesce(F.sum("told"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("told").isNull(), F.col("aim"))), F.lit(0.0))).first()
            share = share.withColumn("aim", F.coalesce("told", F.col("aim") * (max(0.0, 1 - sums[0]) / sums[1] if sums[1] else 0.0)))
        whole = share.agg(F.sum("aim")).first()[0]
        aims[c] = saved(share.select(c, (F.col("aim") / whole if whole else F.lit(0.0)).alias("aim")), "aims")

    def factors(c):
        now = cells.groupBy(c).agg((F.sum(F.col("mass") * F.col("weight")) / total).alias("now")).join(aims[c], c)
        return now.select(c, F.when(F.col("now") > 0, F.col("aim") / F.col("now")).otherwise(1.0).alias("factor"), F.when((F.col("now") > 0) & (F.col("aim") > 0), F.abs(F.col("now") / F.col("aim") - 1)).alias("gap"))

    gap = 0.0
    for _ in range(rounds):
        gap = 0.0
        for c in CELL:
            factor = saved(factors(c), "factors")
            gap = max(gap, factor.agg(F.max("gap")).first()[0] or 0.0)
            cells = saved(cells.join(factor, c).select(*CELL, "mass", (F.col("weight") * F.col("factor")).alias("weight")), "raked")
        if gap < close:
            break
    else:
        gap = max((factors(c).agg(F.max("gap")).first()[0] or 0.0 for c in CELL), default=gap)
    least, largest = cells.where("mass > 0 and weight > 0").agg(F.min("weight"), F.max("weight")).first()
    kept = lambda s: cells.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * s) * F.col("mass"))).first()[0] / total
    scale = scale_for(kept, (least or float("inf"), largest or 0), budget, 60)
    return cells.select(*CELL, "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability"), (F.col("weight") * scale > 1 + 1e-9).alias("capped")), gap


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: list[str] | None = None, targets: dict[str, dict[str | None, float]] | None = None, temper: float = TEMPER, budget: float | None = RETAIN, seed: int = SEED, topics: int = TOPICS) -> DataFrame:
    """(row, source, lang, topic, tokens, weight, probability, capped, raking_gap, sampled): row has the columns to keep."""
    spark = docs.sparkSession
    rows = celled(docs, docs.columns if keep is None else keep, id_col, text_col, source_col, lang_col, seed, topics)
    cells = saved(rows.groupBy(*CELL).agg(F.sum("tokens").cast("double").alias("mass")), "cells")
    n = cells.count()
    if n <= LOCAL_CELLS:
        table, gap = raked_locally(cells, targets or {}, temper, budget)
        calibrated = spark.createDataFrame(table) if n else spark.createDataFrame([], "source string, lang string, topic string, weight double, probability double, capped boolean")
    else:
        calibrated, gap = raked_in_spark(cells, targets or {}, temper, budget)
    if n <= BROADCAST_CELLS:
        calibrated = F.broadcast(calibrated)
    uniform = (F.shiftrightunsigned("draw", 11).cast("double")) / F.lit(float(1 << 53))
    value = lambda c: F.when(F.col(c) != "", F.expr(f"substring({c}, 2)")).alias(c)
    return rows.join(calibrated, list(CELL), "left").select("row", value("source"), value("lang"), "topic", "tokens", "weight", "probability", "capped", F.lit(float(gap)).alias("raking_gap"), (uniform < F.col("probability")).alias("sampled"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mixture samples, with all of their columns."""
    return mix(docs, **options).where("sampled").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: weight, probability and decision of every document of documents."""
    found = mix(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])
