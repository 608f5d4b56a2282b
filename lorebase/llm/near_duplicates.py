"""Near-duplicate groups: an exact join of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8.

Method: token-combination prefixes. The tokens are shingles. Documents with one and the same set form a class, and
everything below joins classes. Tokens are ordered from rare to frequent by the number of documents that hold them.
A set x of n tokens that is similar to another misses at most e = n - ceil(0.8 n) of its own tokens there, so two
similar sets share more than p - e of the first p tokens of the one whose prefix ends first. Rare tokens are indexed
alone. Frequent tokens fall into COMBO_CLASSES classes by hash, and only pairs of one class are indexed; a set may then
share one token of each class without sharing a pair, so its prefix is extended to the least p with
p > e + (number of classes met in it). Small sets of frequent tokens only, for which no such p exists, also index
the tokens of their plain prefix alone, and their pairs over the whole set. So no similar pair is lost. Candidates
pass a test of sizes and of parity bitmaps (both without false negatives) and are then verified on the full sets.

Groups: of the classes that share a signature only pairs with the list's smallest class are verified at first; the
links found are closed to components. Then all candidate pairs that still lie in two components. So a group of g near
copies costs about g verifications instead of g * g, and no component is missed. Pairs inside long lists are compared
by bitmaps in blocks; of those that pass only trees become rows, and all classes that these connect are compared on
their full sets in blocks, as for the links below, which give trees of links. So rows grow with the lists' members.

Links: each document is given the number of other sets that its set is similar to. Every link lies inside a
component, so all pairs of each component's classes are compared on their full sets, once each: components of two have
their one link, larger ones are dealt in blocks of LINK_BLOCK classes and LINK_TOKENS tokens, and pairs of blocks give
one count for each class. Rows grow with blocks, not with the square of a group; the comparisons are all made.

Scale: texts are read once; the sets, 8 bytes for each shingle, are written to the shared folder, one copy of a class
from each task, and read by the later passes. They are shuffled for candidates that the bitmaps left only. Document
frequencies are counted over all of them, as sorted and delta-coded token hashes. Work that is dealt by hash goes to
buckets whose number follows from the number of tokens, so a bucket does not grow with the input. What is broadcast is
the list of the MAX_FREQUENT most frequent tokens at most, 12 bytes each (a token that does not make the list is treated
as rare: that lengthens lists but loses nothing), and a Bloom filter of at most MAX_BLOOM_BITS, beyond whose reach more
sets are shuffled, but none is lost. Components come from alternating large-star and small-star rounds, each written to
the shared folder.

Cases: null, empty and blank texts have an empty set, n_shingles 0, and are their own component; texts of one to four
words have one shingle, the whole sequence. Rows with equal doc_id or null doc_id are handled row by row: each
returns its own line, and a component's id is the smallest non-null doc_id in it. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import dropped, lean, load, most_frequent, quoted, saved, slots, spread, writing
from ._text import chunks, mix, shingle_sets

_U = np.uint64
#: A token in more documents than this is frequent.
FREQUENT = 16
#: Frequent tokens that are told apart at most, the most frequent ones first.
MAX_FREQUENT = 1 << 20
#: Classes of frequent tokens, of which pairs are indexed.
COMBO_CLASSES = 128
MAX_BLOOM_BITS = 1 << 27
#: Members up to which a list is joined with itself, and members of a block of a longer one.
WIDE = 64
BLOCK = 4096
#: Classes and tokens of a block in which the links of a component are counted.
LINK_BLOCK = 1024
LINK_TOKENS = 1 << 19
#: Bits of a token hash that are counted; 2**40 leaves one in 1000 tokens with another's count at 10**9 tokens.
COUNT_BITS = 40
_INFO = "id long, digest binary, n_shingles long, class binary, key long, bits binary, tokens binary"
#: Tokens of a bucket and buckets, about: more buckets come only when these hold MOST_TOKENS.
BUCKET_TOKENS, MOST_TOKENS, FEW_BUCKETS = 1 << 18, 1 << 24, 1 << 15
#: Tokens that a task sorts at once, and at most where there are many buckets.
FLUSH, MOST_FLUSH = 1_000_000, 32_000_000


def _similar(inter, n, m, percent=80):
    return 100 * inter >= percent * (n + m - inter)


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of about 2n bits: the number of bits that differ is at most |x ^ y|."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    at = (s >> _U(20)).astype(np.int64) & (size - 1)
    if len(s) < 1 << 20:
        return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()
    at.sort()  # of a very large set only the bits that are set are counted
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    odd = np.zeros(size, bool)
    odd[at[first]] = np.diff(np.append(first, len(at))) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _class(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _key(cls: bytes) -> int:
    return int.from_bytes(cls[:8], "little", signed=True)


def describe(docs: DataFrame) -> DataFrame:
    """Rows of _INFO of (id, digest, text): set size, digest of the set, its first 8 bytes, bitmap, and the set itself, null
    where the task has given it with an earlier row."""

    def run(batches):
        held: list[tuple] = []
        known: set[bytes] = set()
        size = 0

        def out():
            columns = zip(*held, strict=True) if held else [()] * 7
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "digest", "n_shingles", "class", "key", "bits", "tokens"])

        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, off, data in chunks(batch.column(2)):
                flat, first = shingle_sets(off, data)
                for i in range(len(first) - 1):
                    s = flat[first[i] : first[i + 1]]
                    cls = _class(s) if len(s) else None
                    new = cls and cls not in known
                    tokens = s.tobytes() if new else None
                    held.append((ids[a + i], digests[a + i], len(s), cls, cls and _key(cls), cls and _bitmap(s), tokens))
                    if new:
                        known.add(cls)
                        size += len(tokens)
                    if size > 4 << 20 or len(held) >= 5000:
                        yield out()
                        held.clear()
                        size = 0
        yield out()

    return docs.mapInArrow(lean(run), _INFO)


def _tokens(column: pa.Array) -> np.ndarray:
    """All tokens of a column of sets, end to end."""
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(_U) if len(column) else np.empty(0, _U)


def bucket_count(tokens: int) -> int:
    """Buckets for so many tokens."""
    return max(64, min(tokens // BUCKET_TOKENS, max(FEW_BUCKETS, tokens // MOST_TOKENS)))


def _pack(sorted_values: np.ndarray, kind: type = np.uint16) -> bytes:
    """Sorted distinct values as steps of 16 or 32 bits; a step of the greatest number only adds."""
    most = _U(np.iinfo(kind).max)
    steps = np.diff(sorted_values, prepend=_U(0)).astype(np.uint64)
    extra = (steps // most).astype(np.int64)
    if not extra.any():
        return steps.astype(kind).tobytes()
    out = np.full(len(steps) + int(extra.sum()), most, kind)
    out[np.arange(len(steps)) + np.cumsum(extra)] = steps % most
    return out.tobytes()


def _unpack(blob: bytes, kind: type = np.uint16) -> np.ndarray:
    steps = np.frombuffer(blob, kind)
    return np.cumsum(steps, dtype=_U)[steps != np.iinfo(kind).max]


def frequent_tokens(sets: DataFrame, buckets: int, frequent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes (COUNT_BITS bits) of the tokens in over `frequent` documents, at most `most`, and the counts."""
    span = -(-(1 << COUNT_BITS) // buckets)
    flush_at = min(MOST_FLUSH, max(FLUSH, 256 * buckets))
    kind = np.uint32 if (1 << COUNT_BITS) // flush_at > 1 << 15 else np.uint16  # by the mean step between tokens

    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(values, np.arange(buckets + 1, dtype=np.uint64) * _U(span))
            rows = [(b, values[x:y] - _U(b * span), times[x:y]) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            return pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([_pack(r[1], kind) for r in rows], pa.binary()),
                 pa.array([np.flatnonzero(r[2] > 1).astype(np.uint32).tobytes() for r in rows], pa.binary()), pa.array([r[2][r[2] > 1].astype(np.uint32).tobytes() for r in rows], pa.binary())],
                names=["bucket", "steps", "at", "times"],
            )

        for batch in batches:
            held.append(_tokens(batch.column(0)) >> _U(64 - COUNT_BITS))
            size += len(held[-1])
            if size > flush_at:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def total(bucket, table):
        values, times = [], []
        for steps, at, n in zip(*(table.column(c).to_pylist() for c in ("steps", "at", "times")), strict=True):
            v = _unpack(steps, kind)
            t = np.ones(len(v), np.int64)
            t[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
            values.append(v)
            times.append(t)
        values, times = np.concatenate(values), np.concatenate(times)
        order = np.argsort(values, kind="stable")
        values, times = values[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        sums = np.add.reduceat(times, first)
        keep = sums > frequent
        return pa.table([pa.array(values[first][keep].astype(np.int64) + bucket[0].as_py() * span), pa.array(sums[keep])], names=["token", "n"])

    counts = saved(sets.select("tokens").mapInArrow(lean(count), "bucket int, steps binary, at binary, times binary").groupBy("bucket").applyInArrow(total, "token long, n long"), "frequent")
    found = most_frequent(counts, most).toArrow()  # bounded by `most`
    tokens, n = found.column("token").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    dropped(counts)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def signatures(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, marks: np.ndarray, percent: int = 80) -> np.ndarray:
    """The signatures under which a set is indexed; see the module's text."""
    n = len(s)
    errors = n - -(-percent * n // 100)
    short = s >> _U(64 - COUNT_BITS)
    maybe = np.flatnonzero(marks[(short & _U(len(marks) - 1)).astype(np.int64)])
    if not len(maybe) or not len(tokens):
        return mix(s[: errors + 1])
    at = np.minimum(np.searchsorted(tokens, short[maybe]), len(tokens) - 1)
    hit = tokens[at] == short[maybe]
    often, rank = maybe[hit], counts[at[hit]]
    rare = np.delete(s, often)
    if len(rare) > errors:
        return mix(rare[: errors + 1])
    often = s[often[np.lexsort((s[often], rank))]]  # from rarer to more frequent
    group = (mix(often) & _U(COMBO_CLASSES - 1)).astype(np.int64)
    new = np.zeros(len(group), np.int64)
    new[np.unique(group, return_index=True)[1]] = 1
    length = len(rare) + 1 + np.arange(len(often))
    enough = np.flatnonzero(length > errors + np.cumsum(new))
    upto = int(enough[0]) + 1 if len(enough) else len(often)
    out = [mix(rare)]
    order = np.argsort(group[:upto], kind="stable")
    t, g = often[:upto][order], group[:upto][order]
    edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            i, j = np.triu_indices(b - a, 1)
            lo, hi = np.minimum(t[a:b][i], t[a:b][j]), np.maximum(t[a:b][i], t[a:b][j])
            out.append(mix(lo * _U(0x9E3779B97F4A7C15) ^ hi))
    if not len(enough):
        out.append(mix(often[: errors + 1 - len(rare)] ^ _U(0x94D049BB133111EB)))
    return np.concatenate(out)


def candidate_lists(sets: DataFrame, tokens: np.ndarray, counts: np.ndarray, buckets: int, percent: int) -> DataFrame:
    """Distinct (list, key): the classes that share a signature, for signatures of two classes or more."""
    marks = np.zeros(max(1 << 16, min(1 << 24, 1 << (16 * len(tokens)).bit_length())), bool)
    marks[(tokens & _U(len(marks) - 1)).astype(np.int64)] = True
    model = sets.sparkSession.sparkContext.broadcast((tokens, counts, np.packbits(marks)))
    flush_at = min(MOST_FLUSH, max(FLUSH, 256 * buckets)) // 2

    def sign(batches):
        tokens, counts, packed = model.value
        marks = np.unpackbits(packed).astype(bool)
        sigs, keys, size = [], [], 0

        def flush():
            s = np.concatenate(sigs)
            k = np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
            b = ((s >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            s, k, b = (s & _U(0xFFFFFFFF)).astype(np.uint32)[order], k[order], b[order]
            edges = np.searchsorted(b, np.arange(buckets + 1))
            rows = [(i, s[x:y].tobytes(), k[x:y].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "sigs", "keys"])

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sigs.append(signatures(np.frombuffer(own, _U), tokens, counts, marks, percent))
                keys.append(key)
                size += len(sigs[-1])
                if size > flush_at:
                    yield flush()
                    sigs.clear(), keys.clear()
                    size = 0
        if sigs:
            yield flush()

    def group(_, table):
        sigs = [np.frombuffer(x, np.uint32) for x in table.column("sigs").to_pylist()]
        keys = [np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()]
        s, k = np.concatenate(sigs), np.concatenate(keys)
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])))
        s, k = s[new], k[new]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(first, len(s)))
        with np.errstate(over="ignore"):
            lists = mix(np.add.reduceat(mix(k.view(np.uint64)), first) + size.astype(np.uint64))  # of a set of keys
        keep = size > 1
        _, once = np.unique(lists[keep], return_index=True)
        first, size, lists = first[keep][once], size[keep][once], lists[keep][once]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)
        return pa.table([pa.array(np.repeat(lists.view(np.int64), size)), pa.array(k[at])], names=["list", "key"])

    signed = sets.select("key", "tokens").mapInArrow(lean(sign), "bucket int, sigs binary, keys binary")
    return signed.groupBy("bucket").applyInArrow(group, "list long, key long").distinct()


def _bloom_hashes(keys: np.ndarray, bits: int):
    h = mix(keys.view(np.uint64))
    for _ in range(3):
        yield (h & _U(bits - 1)).astype(np.int64)
        h = mix(h + _U(0x9E3779B97F4A7C15))


def _bloom(keys: DataFrame, n: int) -> np.ndarray:
    bits = min(MAX_BLOOM_BITS, max(1 << 16, 1 << (16 * max(1, n)).bit_length()))

    def run(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            for at in _bloom_hashes(batch.column(0).to_numpy(), bits):
                held[at] = True
        if held.any():
            yield pa.record_batch([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in keys.repartition(4).mapInArrow(lean(run), "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis: bytes) folded to `size` bytes: parities of the smaller bitmap."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def compare(table: pa.Table, percent: int) -> pa.Table:
    """Pairs (a, b) that connect what sizes and bitmaps let be similar of rows (key, root, n, bits, block, i, j).

    Only rows of two roots, one of block i and one of block j, are held against each other. Of the pairs found those are
    given that form a tree over the rows of each group that they connect, fewer than rows.
    """
    keys, roots, n = (table.column(c).to_numpy() for c in ("key", "root", "n"))
    block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    bits = table.column("bits").to_pylist()
    width = np.array([len(x) for x in bits])
    levels = {w: (at, np.frombuffer(b"".join(bits[k] for k in at), np.uint8).reshape(len(at), w)) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}
    names, code = np.unique(roots, return_inverse=True)
    major = np.argmax(np.bincount(code))
    found, group = [], np.arange(len(keys))
    for x in np.flatnonzero(code != major):
        for w, (at, rows) in levels.items():
            size = min(w, width[x])
            if max(w, width[x]) > 2 * size:
                continue  # sizes are further apart than similar sets' can be
            ok = (code[at] != code[x]) & ((code[at] == major) | (keys[at] > keys[x])) & (100 * np.minimum(n[at], n[x]) >= percent * np.maximum(n[at], n[x]))
            if i != j:
                ok &= block[at] != block[x]
            at_ok = at[ok]
            if not len(at_ok):
                continue
            apart = np.bitwise_count(_fold(rows[ok], size) ^ _fold(np.frombuffer(bits[x], np.uint8), size)).sum(axis=1, dtype=np.int64)
            near = _similar((n[at_ok] + n[x] - apart) // 2, n[at_ok], n[x], percent)
            others, y = np.unique(group[at_ok[near]], return_index=True)
            new = others != group[x]
            if new.any():
                found += [(x, k) for k in at_ok[near][y[new]]]
                group[np.isin(group, others[new])] = group[x]
    pairs = np.array([(keys[x], keys[y]) for x, y in found], np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def crossing(lists: DataFrame, roots: DataFrame, one: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of one list that lie in two components, and pairs that connect the candidates of long lists.

    Pairs are made of a row outside its list's largest component and any other row. Lists of up to WIDE members are
    joined with themselves; longer ones are compared in blocks of BLOCK members, so no task holds a long list, and give
    compare()'s trees, of which linked_groups() holds all members against each other.
    """
    placed = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").select("list", "key", F.coalesce("root", "key").alias("root"))
    split = placed.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("list", "size")
    placed = saved(placed.join(split, "list"), "placed")
    short, long_ = placed.where(F.col("size") <= WIDE), placed.where(F.col("size") > WIDE)
    major = short.groupBy("list", "root").count().groupBy("list").agg(F.max(F.struct("count", "root"))["root"].alias("major"))
    short = short.join(major, "list")
    minor = short.where("root <> major").select("list", F.col("key").alias("p"), F.col("root").alias("pr"))
    joined = minor.join(short, "list").where("pr <> root and (root = major or p < key)").select(F.least("p", "key").alias("a"), F.greatest("p", "key").alias("b"))

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = long_.join(one, "key").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).select("list", "key", "root", "n", "bits", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    compared = dealt.groupBy("list", "i", "j").applyInArrow(lambda _, table: compare(table, percent), "a long, b long")
    return joined.distinct(), compared.distinct()


def _maybe(needed: DataFrame, n: int):
    """A condition on a column of longs: true of all n of needed, and of a few others."""
    filter_ = needed.sparkSession.sparkContext.broadcast(_bloom(needed, n))

    @F.arrow_udf("boolean")  # keys alone go to the workers
    def maybe(keys: pa.Array) -> pa.Array:
        packed, held, out = filter_.value, keys.to_numpy(zero_copy_only=False), np.ones(len(keys), bool)
        for at in _bloom_hashes(held, len(packed) * 8):
            out &= (packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pa.array(out)

    return maybe


def full_sets(needed: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(key, tokens) of the distinct class keys in needed, and of a few others; None if there are none."""
    n = needed.count()
    if not n:
        return None
    return saved(sets.where(_maybe(needed, n)("key")).groupBy("key").agg(F.first("tokens").alias("tokens")), "sets")


def verify(pairs: DataFrame, one: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar ones of distinct candidate pairs (a, b) of class keys; one: (key, n, bits) of every class."""

    def near(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(np.frombuffer(x, np.uint8), size) ^ _fold(np.frombuffer(y, np.uint8), size)).sum())
                keep.append(_similar((n + m - apart) // 2, n, m, percent))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = one.select(F.col("key").alias("a"), "n", F.col("bits").alias("x")), one.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").where("100 * least(n, m) >= %d * greatest(n, m)" % percent)
    kept = saved(sized.select("a", "b", "n", "m", "x", "y").mapInArrow(lean(near), "a long, b long"), "near")
    held = full_sets(kept.select(F.explode(F.array("a", "b")).alias("key")).distinct(), sets)
    if held is None:
        return kept

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                keep.append(_similar(int((p[at] == q).sum()), len(p), len(q), percent))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = kept.join(held.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(held.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    links = saved(both.select("a", "b", "x", "y").mapInArrow(lean(linked), "a long, b long"), "links")
    dropped(held, kept)
    return links


def _print(edges: DataFrame) -> tuple:
    """What two sets of edges have in common if they are equal: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected links (a, b): root is the component's smallest node.

    Large-star and small-star steps in turn, until nothing changes; each round is written to the shared folder.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _print(edges)
    while mark[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = saved(small, "small")
        before, mark = mark, _print(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, frequent: int, most: int, digests: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """describe() of docs, (key, n, bits) of every class, (node, root) of the components, (key, tokens) of every class."""
    digest = F.unhex(F.md5(text_col)) if digests else F.lit(None).cast("binary")
    info = saved(describe(docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.col(text_col).alias("text"))), "sets")
    sets = info.where("tokens is not null").select("key", "tokens")
    with writing(docs.sparkSession):
        buckets = bucket_count(info.where("tokens is not null").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    tokens, counts = frequent_tokens(sets, buckets, frequent, most)
    lists = saved(candidate_lists(sets, tokens, counts, buckets, percent), "lists")

    one = saved(info.where("key is not null").groupBy("key").agg(F.max("n_shingles").alias("n"), F.first("bits").alias("bits")), "classes")

    heads = lists.groupBy("list").agg(F.min("key").alias("least"))
    tried = saved(lists.join(heads, "list").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct(), "stars")
    roots = components(verify(tried, one, sets, percent))
    pairs, near = crossing(lists, roots, one, percent)
    pairs, near, links = saved(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), saved(near, "trees"), []
    if not pairs.isEmpty():
        links.append(verify(pairs, one, sets, percent))
    if not near.isEmpty():
        links.append(linked_groups(near, one, sets, percent))
    if any(not found.isEmpty() for found in links):
        for found in links:
            roots = roots.unionByName(found.select(F.col("a").alias("node"), F.col("b").alias("root")))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))

    return info, one, roots, sets


def shared(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of each of the first sets with each of the others, or of all sets if first is 0."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(starts, len(flat)))
    # tokens of one and the same sets are one column, weighted by their number
    with np.errstate(over="ignore"):
        pattern = np.add.reduceat(mix(mix(np.arange(1, len(sets) + 1, dtype=np.uint64)))[owner], starts)
    starts, held, pattern = starts[held > 1], held[held > 1], pattern[held > 1]
    _, once, times = np.unique(pattern, return_index=True, return_counts=True)
    starts, held = starts[once], held[once]
    kind = np.float32 if max(map(len, sets)) < 1 << 24 else np.float64
    out = np.zeros((first or len(sets), len(sets) - first), kind)
    for a in range(0, len(starts), 1024):
        n, x = held[a : a + 1024], np.zeros((len(starts[a : a + 1024]), len(sets)), kind)
        row = np.repeat(np.arange(len(n)), n)
        x[row, owner[np.repeat(starts[a : a + 1024] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = 1
        out += (x[:, : first or len(sets)] * times[a : a + 1024, None].astype(kind)).T @ x[:, first:]
    return out.astype(np.int64)


def _compared(table: pa.Table, percent: int):
    """(class keys, how many of them are of block i, similar or not) for each root of rows (key, root, block, tokens, i, j):
    those of block i against those of block j, or all against all if i is j, for which the second is 0."""
    roots, block = table.column("root").to_numpy(), table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.lexsort((block != i, roots))
    roots, block, keys = roots[order], block[order], table.column("key").to_numpy()[order]
    tokens = table.column("tokens").to_pylist()
    edges = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        sets = [np.frombuffer(tokens[k], _U) for k in order[a:b]]
        first = int((block[a:b] == i).sum()) if i != j else 0
        if i != j and first in (0, b - a):
            continue
        n = np.array([len(x) for x in sets])
        near = _similar(shared(sets, first), n[: first or len(n), None], n[None, first:], percent)
        if i == j:
            np.fill_diagonal(near, False)
        yield keys[a:b], first, near


def count_links(table: pa.Table, percent: int) -> pa.Table:
    """(key, links) of rows (key, root, block, tokens, i, j): similar pairs of one root, a row of block i and one of j."""
    keys, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for own, first, near in _compared(table, percent):
        keys.append(own)
        links.append(np.concatenate([near.sum(axis=1), near.sum(axis=0)]) if first else near.sum(axis=1))
    return pa.table({"key": np.concatenate(keys), "links": np.concatenate(links)})


def tree_links(table: pa.Table, percent: int) -> pa.Table:
    """Similar pairs (a, b) of rows as for count_links(), those that form a tree over each group that such pairs connect."""
    found = [np.empty((0, 2), np.int64)]
    for keys, first, near in _compared(table, percent):
        left, pairs = np.ones(len(keys), bool), []
        for start in range(len(keys)):
            waiting = [start] if left[start] else []
            left[start] = False
            while waiting:
                x = waiting.pop()
                mine = near[x] if not first else near[x] if x < first else near[:, x - first]
                offset = first if first and x < first else 0
                others = np.flatnonzero(mine & left[offset : offset + len(mine)]) + offset
                left[others] = False
                pairs += [(x, y) for y in others.tolist()]
                waiting += others.tolist()
        if pairs:
            found.append(keys[np.array(pairs)])
    found = np.concatenate(found)
    return pa.table({"a": found.min(axis=1), "b": found.max(axis=1)})


def _sized(roots: DataFrame, one: DataFrame) -> DataFrame:
    """(key, root, size, tokens, blocks) of every class of a component of two classes or more, written once."""
    members = roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct()).join(one.select("key", "n"), "key")
    members = saved(members, "rooted")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    sizes = sizes.select("root", "size", F.ceil(F.greatest(F.col("size") / LINK_BLOCK, F.col("tokens") / LINK_TOKENS)).cast("int").alias("blocks"))
    out = saved(spread(members.drop("n"), sizes, "root"), "members")
    dropped(members)
    return out


def _in_blocks(members: DataFrame, held: DataFrame, work, schema: str) -> DataFrame:
    """What work() gives for each pair of blocks of the members of one component; held: their sets."""
    more = members.join(held, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    buckets = max(64, 4 * slots(members.sparkSession))
    more = more.withColumn("of", F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets)))).withColumn("long", F.col("blocks") > 1)
    more = more.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = more.select("key", "root", "block", "tokens", "of", "long", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return dealt.groupBy("of", "long", "i", "j").applyInArrow(lambda _, table: work(table), schema)


def linked_groups(near: DataFrame, one: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes that pairs near (a, b) connect: all of one group are compared on their full sets, and those
    links are given that connect what any links connect."""
    members = _sized(components(near), one)
    held = full_sets(members.select("key"), sets)
    links = saved(_in_blocks(members, held, lambda table: tree_links(table, percent), "a long, b long"), "links")
    dropped(held, members)
    return links


def link_counts(roots: DataFrame, one: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, links): the number of similar classes of every class of a component of two classes or more."""
    members = _sized(roots, one)
    two = members.where("size = 2").select("key", F.lit(1).cast("long").alias("links"))
    held = full_sets(members.where("size > 2").select("key"), sets)
    if held is None:
        return two
    counted = _in_blocks(members.where("size > 2"), held, lambda table: count_links(table, percent), "key long, links long")
    found = saved(two.unionByName(counted.groupBy("key").agg(F.sum("links").alias("links"))), "counts")
    dropped(held, members)
    return found


def _placed(info: DataFrame, roots: DataFrame) -> DataFrame:
    """(class, key, component_id) of every class of a set with tokens."""
    classes = info.where("class is not null").groupBy("key", "class").agg(F.min("id").alias("least"))
    rooted = saved(classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("class", "key", "least", F.coalesce("root", "key").alias("root")), "placed")
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread(rooted, group, "root").select("class", "key", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, frequent: int = FREQUENT, most: int = MAX_FREQUENT) -> DataFrame:
    """(id_col, n_shingles, component_id, class, n_links) for every row of docs; n_links: other sets similar to its own."""
    info, one, roots, sets = _grouped(docs, id_col, text_col, percent, frequent, most)
    of = _placed(info, roots).join(link_counts(roots, one, sets, percent), "key", "left").drop("key")
    return spread(info.select("id", "n_shingles", "class"), of, "class", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "class", F.coalesce("links", F.lit(0)).alias("n_links")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row of each group: the one of the smallest id (nulls last), then of the least digest of its text.

    Of rows equal in id and text the one with the least hash of all columns stays. Rows without words belong to no group
    and stay, all of them.
    """
    info, _, roots, _ = _grouped(docs, id_col, text_col, percent, FREQUENT, MAX_FREQUENT, digests=True)
    # rows equal in id and text are one here
    own = info.where("key is not null").groupBy("key", "id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    own = saved(own.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).drop("key"), "own")
    group = own.groupBy("root").agg(F.sum("rows").alias("all"), F.min(F.struct(F.isnull("id").alias("none"), "id", "digest")).alias("first")).where(F.col("all") > 1)
    # what is not met here stays; the others go, or are several of which one stays
    met = spread(own, group, "root").select("id", "digest", "rows", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))).alias("first")).where("not first or rows > 1")
    met = saved(met.select("id", "digest", "first", F.xxhash64("id", "digest").alias("of")), "met")
    dropped(info)  # the rest goes by met alone
    n = met.count()
    if not n:
        return docs
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.unhex(F.md5(text_col)).alias("own_digest")).withColumn("of", F.xxhash64("own_id", "own_digest"))
    maybe = _maybe(met.select("of"), n)
    # texts that surely aren't met are not shuffled
    near = saved(rows.where(maybe("of")).drop("of"), "maybe")
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    several = near.join(met.where("first"), same).groupBy("own_id", "own_digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    stay = rows.where(~maybe("of")).select("row").unionByName(near.join(met, same, "left_anti").select("row"))
    return stay.unionByName(several.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document of documents."""
    return near_duplicates(load(spark, sf_dir, "documents")).drop("class")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT i, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) END AS g FROM d),
t AS (SELECT i, hash(u.x) AS h FROM s, unnest(s.g) AS u(x)),
c AS (SELECT p.i AS a, q.i AS b, count(*) AS n FROM t p JOIN t q ON p.h = q.h AND p.i < q.i GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.i = a JOIN s y ON y.i = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT a AS i, count(DISTINCT list_sort(y.g)) AS n FROM e JOIN s x ON x.i = a JOIN s y ON y.i = b WHERE list_sort(x.g) <> list_sort(y.g) GROUP BY a),
r AS (WITH RECURSIVE w(i, j) AS (SELECT i, i FROM s UNION SELECT w.i, e.b FROM w JOIN e ON w.j = e.a) SELECT * FROM w)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, z.component_id, coalesce(k.n, 0) AS n_links FROM s LEFT JOIN k USING (i) JOIN (SELECT r.i, min(o.doc_id) AS component_id FROM r JOIN s o ON o.i = r.j GROUP BY r.i) z USING (i)
"""
