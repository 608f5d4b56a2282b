"""Language identification by cross-parsing entropy.

For each language the labelled text of a bounded sample is put into a suffix automaton, which holds all of its
substrings. A text is parsed by each automaton into phrases, each the longest match that begins where the last phrase
ended (at least one symbol). The language that needs the fewest phrases, each weighted by the log of its sample's
size, wins; ties go to the language that comes first by name.

Symbols are the UTF-8 bytes of the lower-cased text in which each run of other characters than letters is one blank. A
letter is what ``str.isalpha`` says, categories L of Unicode, in learning and in judging alike. Each automaton knows
the bytes of its own sample; any other byte is a phrase of its own, in every script.

Automata are compiled to tables of next states: a step that has no successor ends the phrase and starts the next one
at the root. Texts of a batch are cut into lanes of LANE bytes, and all lanes step at once through numpy tables, as if
a phrase began with each lane. Where a lane begins inside a phrase of the lane before, it is parsed again with that
phrase's state until both parses begin a phrase at the same byte, after which they are one; so the phrases are those
of one parse of the whole text, and the time per character is constant.

Fitting takes whole texts of a bounded sample of labelled rows: of each language the SAMPLE_DOCS distinct texts with the
least hash of text and language (copies count once), in that order, as far as they fit into its share of bytes, which is
SAMPLE_BYTES or an equal part of TOTAL_BYTES if there are many languages. No language is left out: one whose texts are
all longer takes its shortest, whole. The bounds are the parameters sample_docs, sample_bytes and total_bytes. Nothing
else is sampled. The samples are what is sent to the workers, 2 TOTAL_BYTES or so; workers compile them once.

Cases: a null text or one without a letter gets ``und`` with score 0. Null lang rows, and texts without letters, are
not learned from. With no learned language every text gets ``und``, with one its score is 1. Rows with equal or null
doc_id are judged one by one (a null doc_id belongs to the learning part). Empty tables give no rows. Other columns
are not read by predict() and are kept by accepted(), whatever their names.

accepted() judges rows that it also learns from, by FOLDS models: each text by the one that has seen neither it nor a
copy of it. Before that the sampled texts whose label the model of their own fold contradicts are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import lean, load, quoted, saved

SAMPLE_DOCS = 200
SAMPLE_BYTES = 48_000
TOTAL_BYTES = 1 << 20
LANE = 128
#: Parts of the labelled texts, by a hash of the text, of which each is judged by what the others taught (accepted()).
FOLDS = 2
ROUNDS = 3
#: Characters of text that are parsed at once (a longer text is parsed alone).
BATCH = 1_000_000
#: Languages whose rates of drawing (some 50 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
#: The score from which a prediction against a document's label rejects it.
SURE = 0.1
_BLANK = 32


def letters() -> np.ndarray:
    """Of every code point whether it is a letter."""
    return np.array([chr(p).isalpha() for p in range(0x110000)])


def normal(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, has a letter) of texts: lower-cased letters with one blank for each run of other characters."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    own = letter[points]
    keep = own.copy()  # a blank stays behind a letter, or at the start of a text
    keep[1:] |= own[:-1]
    keep[first[:-1][first[:-1] < first[1:]]] = True
    points = np.where(own, points, _BLANK)[keep]
    sums = np.concatenate(([0], np.cumsum(keep)))
    any_ = np.concatenate(([0], np.cumsum(own)))[first]
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    data = points.astype(np.uint8) if len(size) == size.sum() else np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return data, np.concatenate(([0], np.cumsum(size)))[sums[first]], any_[1:] > any_[:-1]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state (0 is the root) of the automaton of all substrings."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """One language's automaton as a table; entries are twice the next state's row, plus 1 if a phrase begins."""

    def __init__(self, texts: list[bytes]):
        # no text holds a zero byte: it keeps the sample's texts apart
        symbols = np.frombuffer(b"\0".join(texts), np.uint8)
        known = np.unique(symbols[symbols > 0])
        self.codes = np.zeros(256, np.uint8)  # 0: a byte that the sample lacks
        self.codes[known] = np.arange(1, len(known) + 1)
        width = self.width = len(known) + 1
        nxt = suffix_automaton(self.codes[symbols].tolist())
        root = np.ones(width, np.int64 if len(nxt) * width > 1 << 29 else np.int32)
        for c, to in nxt[0].items():
            if c:
                root[c] = to * (2 * width) + 1
        table = np.tile(root, (len(nxt), 1))  # the one table that is ever held
        for state, moves in enumerate(nxt):
            for c, to in moves.items():
                if c and state:
                    table[state, c] = to * (2 * width)
        self.table = table.reshape(-1)
        self.weight = np.log2(max(2, sum(map(len, texts))))


class Parser:
    """The automata of all languages, and the phrases that texts need under each."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        self.automata = [Automaton(samples[name]) for name in self.languages]
        self.letter = letters()

    def phrases(self, data: np.ndarray, first: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Phrases of each normalised text under each language."""
        size = np.diff(first)
        lanes = -(-size // lane)
        doc = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, left = first[:-1][doc] + k * lane, np.minimum(lane, size[doc] - k * lane)
        order = np.argsort(-left, kind="stable")  # full lanes first: later steps are on a prefix of them
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        live = np.searchsorted(-left[order], -np.arange(lane), "left")
        # steps as rows, lanes as columns
        grid = np.zeros((lane, len(order)), np.uint8)
        for i in range(lane):
            grid[i, : live[i]] = data[begin[order[: live[i]]] + i]
        last = np.append(k[1:] == 0, True)[: len(k)]
        heir = np.where(last[order], -1, place[np.minimum(order + 1, len(order) - 1)])  # the next lane of a lane's text
        out = np.zeros((len(size), len(self.automata)))
        for j, a in enumerate(self.automata):
            out[:, j] = np.bincount(doc[order], weights=_parse(a, a.codes[grid], left[order], live, heir), minlength=len(size))
        return out


def _parse(a: Automaton, grid: np.ndarray, left: np.ndarray, live: np.ndarray, heir: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane; left: bytes of a lane, live: lanes that have a step, heir: the lane behind or -1."""
    steps, n = grid.shape
    starts = np.zeros((steps, n), np.uint8)
    ends = np.zeros(n, a.table.dtype)
    for i in range(steps):
        m = live[i]
        if not m:
            break
        move = a.table[ends[:m] + grid[i, :m]]
        ends[:m] = move >> 1
        starts[i, :m] = move & 1
    count = starts.sum(axis=0, dtype=np.int64)
    out, state = count.copy(), ends.copy()
    came = np.flatnonzero(heir >= 0)
    while len(came):  # lanes whose end the lane behind has yet to start from
        at = heir[came]
        now, met = state[came], np.zeros(len(at), bool)
        more, less = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for i in range(steps):
            open_ = open_[left[at[open_]] > i]
            if not len(open_):
                break
            lane = at[open_]
            move, other = a.table[now[open_] + grid[i, lane]], starts[i, lane]
            same = (move & other & 1).astype(bool)
            met[open_[same]] = True
            open_, move, other = open_[~same], move[~same], other[~same]
            now[open_] = move >> 1
            more[open_] += move & 1
            less[open_] += other
        out[at] = count[at] + more - less
        new = np.where(met, ends[at], now)
        came = at[(new != state[at]) & (heir[at] >= 0)]
        state[at] = new
    return out


def sample(docs: DataFrame, text_col: str, lang_col: str, sample_docs: int, sample_bytes: int, total_bytes: int) -> dict[str, list[bytes]]:
    """Normalised labelled texts of each language, of bounded size."""
    return {name: [text for _, text in own] for name, own in _drawn(docs, text_col, lang_col, sample_docs, sample_bytes, total_bytes).items()}


def _fold(text_col: str):
    """The fold of a text; copies are in one fold, whatever their labels."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(FOLDS)).cast("int")


def _drawn(docs: DataFrame, text_col: str, lang_col: str, sample_docs: int, sample_bytes: int, total_bytes: int) -> dict[str, list[tuple[int, bytes]]]:
    """The (fold, normalised text) of the sample of each language."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), _fold(text_col).alias("fold"))
    labelled = labelled.withColumns({"hash": F.xxhash64("text", "lang"), "size": F.octet_length("text")}).withColumn("draw", F.pmod("hash", F.lit(1_000_000_007)) / F.lit(1_000_000_007.0))
    n_languages = labelled.select("lang").distinct().count()
    if not n_languages:
        return {}
    share = max(1, min(sample_bytes, total_bytes // n_languages))
    # one row for each language, as many as there are automata
    found = labelled.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("size") <= share, F.col("hash"))).alias("n"), F.min(F.struct("size", "hash")).alias("shortest")).collect()
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * sample_docs / r.n) if r.n else 0.0, None if r.n else r.shortest.hash) for r in found], "lang string, rate double, only long")
    rates = F.broadcast(rates) if n_languages <= BROADCAST_LANGUAGES else rates
    fits = (F.col("size") <= share) & (F.col("draw") < F.col("rate"))
    drawn = labelled.join(rates, "lang").where(fits | F.coalesce(F.col("hash") == F.col("only"), F.lit(False))).groupBy("lang", "draw", "hash").agg(F.first(F.struct("fold", "text")).alias("own"))
    best: dict[str, list] = {}
    for r in drawn.toLocalIterator():  # about 2 * sample_docs of each language
        own = best.setdefault(r.lang, [])
        own.append((r.draw, r.hash, r.own.fold, r.own.text))
        if len(own) > 2 * sample_docs:
            own.sort()
            del own[sample_docs:]
    letter, out = letters(), {}
    for name, own in best.items():
        kept, room = [], share
        for *_, fold, text in sorted(own)[:sample_docs]:
            data, _, fine = normal([text], letter)
            if fine[0] and (len(data) <= room or len(own) == 1):
                kept.append((fold, data.tobytes()))
                room -= len(data)
        if kept:
            out[name] = kept
    return out


def judge(parser: Parser, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of texts."""
    data, first, fine = normal(texts, parser.letter)
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if parser.languages and fine.any():
        cost = parser.phrases(data, first)[fine] * np.array([x.weight for x in parser.automata])
        pred[fine] = np.array(parser.languages, object)[np.argmin(cost, axis=1)]
        low = np.partition(cost, min(1, cost.shape[1] - 1), axis=1)
        score[fine] = 1 - low[:, 0] / low[:, 1] if cost.shape[1] > 1 else 1.0
    return pred, score


def consistent(spark: SparkSession, drawn: dict[str, list[tuple[int, bytes]]]) -> list[dict[str, list[bytes]]]:
    """For each fold the samples of the other folds, without the texts whose label their own fold's model contradicts.

    The model of a fold has seen none of its texts, but for a language that has texts in that fold alone: every model knows
    every language, or it would reject the texts of those that it lacks. One task compiles the models, of bounded size, and judges the sample;
    again without what it found, up to ROUNDS times, since wrong labels hide each other.
    A language of which nothing would be left keeps what it had.
    """
    flat = [(name, i, fold, text) for name, own in sorted(drawn.items()) for i, (fold, text) in enumerate(own)]
    others = lambda rows, fold: {name: [t for n, _, f, t in rows if n == name and f != fold] for name in sorted({n for n, _, f, _ in rows if f != fold})}
    sent = spark.sparkContext.broadcast(flat)

    def run(batches):
        for _ in batches:
            rows, out = sent.value, []
            for _ in range(ROUNDS):
                found = []
                for fold in range(FOLDS):
                    own, known = [r for r in rows if r[2] == fold], others(rows, fold)
                    if own and len(known) > 1:
                        pred, _ = judge(Parser(known), [r[3].decode("utf-8", "surrogatepass") for r in own])
                        found += [r[:2] for r, p in zip(own, pred, strict=True) if p != r[0] and r[0] in known]
                rows, out = [r for r in rows if r[:2] not in set(found)], out + found
                if not found:
                    break
            yield pa.record_batch([pa.array([n for n, _ in out], pa.string()), pa.array([i for _, i in out], pa.int64())], names=["lang", "i"])

    wrong = {(r.lang, r.i) for r in spark.range(1, numPartitions=1).mapInArrow(run, "lang string, i long").collect()} if flat else set()  # as many as are sampled at the most
    fine = [r for r in flat if r[:2] not in wrong]
    rest = {name for name, *_ in fine}
    every = fine + [r for r in flat if r[0] not in rest]
    whole = {name: [t for n, _, _, t in every if n == name] for name in drawn}
    return [whole | others(every, fold) for fold in range(FOLDS)]


def identify(docs: DataFrame, learning: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, cross: bool = False, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(row, lang_pred, score) for every row of docs, as a struct of the columns to keep, by automata of the learning rows.

    score is 1 - fewest / second fewest weighted phrases, 1 if only one language was learned. With cross each text is
    judged by automata that hold neither it nor a copy of it, nor sampled texts whose label such automata contradict.
    """
    spark = docs.sparkSession
    drawn = _drawn(learning, text_col, lang_col, sample_docs, sample_bytes, total_bytes)
    models = consistent(spark, drawn) if cross else [{name: [t for _, t in own] for name, own in drawn.items()}]
    # plain values only: a worker need not know this package to read them; it keeps what it compiled beside them
    model = spark.sparkContext.broadcast({"samples": models})

    def run(batches):
        held = model.value
        if "parsers" not in held:
            held["parsers"] = [Parser(s) for s in held["samples"]]
        parsers = held["parsers"]
        for batch in batches:
            # a text that the row holds does not travel twice
            texts = pc.struct_field(batch.column("row"), _position(batch.column("row"), text_col)) if inside else batch.column("text")
            folds = batch.column("fold").to_numpy()
            ends = np.cumsum(np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH, "right")))
                given = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                pred, score = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                for fold, parser in enumerate(parsers):
                    own = np.flatnonzero(folds[a:b] == fold)
                    if len(own):
                        pred[own], score[own] = judge(parser, [given[i] for i in own])
                yield pa.record_batch([batch.column("row").slice(a, b - a), pa.array(pred, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])
                a = b

    inside = keep is None or text_col in keep
    kept = F.struct(*map(quoted, docs.columns if keep is None else keep)).alias("row")
    rows = docs.select(kept, (_fold(text_col) if cross else F.lit(0)).alias("fold"), *([] if inside else [F.col(text_col).alias("text")]))
    return rows.mapInArrow(lean(run), T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def _position(rows: pa.Array, name: str) -> list[int]:
    """The place of a struct's field; a name with a dot would be taken for a path."""
    return [rows.type.get_field_index(name)]


def is_held_out(id_col: str = "doc_id"):
    """Whether crc32(doc_id as text) modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learned from the rows that are not held out."""
    found = identify(docs, docs.where(~is_held_out()), keep=["doc_id"], **options)
    return found.select("row.doc_id", is_held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, sure: float = SURE, **options) -> DataFrame:
    """The rows of docs that have a letter and whose lang is not contradicted with a score of `sure` or more.

    A text is judged by automata that hold no copy of it, so a wrong label does not vouch for itself.
    """
    found = identify(docs, docs.where(~is_held_out()), cross=True, **options)
    against = F.coalesce(F.col("row.lang") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= sure)
    # written here, where Python workers get few MB at a time
    return saved(found.where((F.col("lang_pred") != UNKNOWN) & ~against).select("row.*"), "accepted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document of documents."""
    return predict(load(spark, sf_dir, "documents"))
