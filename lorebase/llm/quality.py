"""Quality rules: base counts of each text and the cross-document frequency of its lines, without Python.

Line frequency: a line is normalised (A-Z lower-cased, runs of digits as one 0, words joined by single blanks) and
hashed. For each host (here: source) and line the distinct texts that hold it are counted; exact copies are one text.
In a line held by more than LINE_LIMIT texts of a host all but the one with the least digest lose it, so a group of
copies keeps one whole member. cleaned() returns the texts without these lines. A text that loses more than
LOST_PERCENT of its words is depleted and rejected, as are texts of fewer than MIN_WORDS words and texts of which more
than REPEAT_PERCENT of the words lie in repeated 8-word windows.

Scale: lines are counted by (host, text, line) and then by (host, line), both with partial sums, so no host and no
line gathers in a task; lines above the limit are joined back by (host, line). judge() never shuffles texts: their
counts travel with a digest. cleaned() joins texts with the hashes of the lines that they lose by (host, digest). In all
of these joins a line or text that many rows have is dealt to several tasks, to which the other side's row is copied.

Cases: a null text has no words and fails; a null source is a host of its own. Rows with equal or null doc_id are
judged one by one; the verdict depends on source and text alone. Empty tables give no rows. Windows are compared by
64-bit hashes of their words. Other columns are not read by judge() and are kept by cleaned().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import SPACE, ascii_lower, load, quoted, saved, spread, words

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
LINE_LIMIT = 20
LOST_PERCENT = 70


def _joined(hashes, step: int):
    """Hashes of each element with the one `step` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    docs = docs.withColumns({"_words": words(text), "_lines": lines})
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_one": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    # windows of 2, 4 and 8 words; each step is a column of its own so that it is worked out once
    docs = docs.withColumn("_two", _joined(F.col("_one"), 1))
    docs = docs.withColumn("_four", _joined(F.col("_two"), 2))
    docs = docs.withColumn("_eight", _joined(F.col("_four"), 4))
    repeats = F.size(F.array_distinct("_eight")) < F.size("_eight")
    docs = docs.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.zip_with(F.slice("_sorted", 1, F.size("_sorted") - 1), F.slice("_sorted", 2, F.size("_sorted") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    docs = docs.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.array_distinct(F.flatten(twins)))))
    steps = F.zip_with(F.slice("_at", 1, F.size("_at") - 1), F.slice("_at", 2, F.size("_at") - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.col("_at").isNotNull(), F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)).otherwise(0)
    docs = docs.withColumn("n_repeat_words", covered.cast("long"))
    return docs.drop("_words", "_lines", "_one", "_two", "_four", "_eight", "_sorted", "_at")


def _host(c: str):
    """A host's key: "=" and its value, or "" for null, so that a null source is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _line(own):
    """The hash of a line's normalised words."""
    return F.xxhash64(F.regexp_replace(ascii_lower(F.array_join(own, " ")), "[0-9]+", "0"))


def lost_lines(docs: DataFrame, host_col: str, text_col: str, line_limit: int, lost_percent: int) -> DataFrame:
    """(_host, _digest, gone, lines) of the texts that lose lines above the limit: the lines' hashes, and whether these
    are more than lost_percent of the text's words."""
    # the digest is worked out before the lines are dealt out, once for each text, and lines don't carry the text
    texts = docs.select(_host(host_col).alias("_host"), F.md5(F.col(text_col)).alias("_digest"), F.split(text_col, "\n").alias("lines"))
    rows = texts.select("_host", "_digest", F.explode("lines").alias("line"))
    own = words(F.col("line"))
    rows = rows.select("_host", "_digest", own.alias("own")).where(F.size("own") > 0)
    rows = rows.select("_host", "_digest", _line(F.col("own")).alias("line"), F.size("own").alias("n"))
    # copies of a text add to all of its lines alike and leave shares as they are
    held = saved(rows.groupBy("_host", "_digest", "line").agg(F.sum("n").alias("n")), "lines")
    above = held.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("texts"), F.min("_digest").alias("keeper")).where(F.col("texts") > line_limit)
    lost = spread(held, above, ["_host", "line"], "left").select("_host", "_digest", "line", "n", (F.col("keeper") != F.col("_digest")).alias("lost"))
    shares = lost.groupBy("_host", "_digest").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("lost"), F.collect_set(F.when(F.col("lost"), F.col("line"))).alias("lines"))
    return shares.where("lost > 0").select("_host", "_digest", (100 * F.col("lost") > lost_percent * F.col("n")).alias("gone"), "lines")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_limit: int = LINE_LIMIT, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """(id_col, the five counts, base_failed, kept) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_source"))
    counted = with_counts(rows, "_text").withColumns({"_host": _host("_source"), "_digest": F.md5("_text")}).drop("_text", "_source")
    gone = lost_lines(rows, "_source", "_text", line_limit, lost_percent).where("gone").drop("lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        spread(counted, gone, ["_host", "_digest"], "left", of=rows.select(_host("_source").alias("_host"), F.md5("_text").alias("_digest"))).withColumn("base_failed", failed)
        .select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))
    )


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_limit: int = LINE_LIMIT, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """The rows of docs that judge() keeps, with all of their columns and without the lines that their texts lose."""
    keys = {"_host": _host("_source"), "_digest": F.coalesce(F.md5("_text"), F.lit(""))}
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), F.col(text_col).alias("_text"), F.col(host_col).alias("_source"))
    fine = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= REPEAT_PERCENT * F.col("n_words"))
    # written before it is filtered: a filter would be pushed below the counts and work them out many times over
    verdicts = saved(with_counts(rows.select("_text", "_source"), "_text").withColumns(keys).select("_host", "_digest", fine.alias("fine")), "verdicts")
    bad = verdicts.where("not fine").select("_host", "_digest", F.lit(True).alias("gone"), F.lit(None).cast("array<long>").alias("lines"))
    fate = bad.unionByName(lost_lines(docs, host_col, text_col, line_limit, lost_percent)).groupBy("_host", "_digest").agg(F.max("gone").alias("gone"), F.first("lines", ignorenulls=True).alias("lines"))
    kept = spread(rows.withColumns(keys), fate, ["_host", "_digest"], "left", of=verdicts).where("gone is null or not gone")
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("lines", _line(words(x)))), "\n")
    text = F.when(F.col("lines").isNotNull(), left).otherwise(F.col("_text"))
    return kept.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document of documents."""
    return judge(load(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT i, host, text, u.x AS line, list_filter(regexp_split_to_array(u.x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS own FROM d, unnest(string_split(t, chr(10))) AS u(x)),
dup AS (SELECT i, count(*) - count(DISTINCT line) AS n FROM l WHERE len(own) > 0 GROUP BY i),
g AS (SELECT i, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS r(k)),
tw AS (SELECT i, g FROM g GROUP BY i, g HAVING count(*) > 1),
rep AS (SELECT i, count(DISTINCT k + o) AS n FROM g JOIN tw USING (i, g), range({WINDOW}) AS x(o) GROUP BY i),
h AS (SELECT DISTINCT host, text, regexp_replace(translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS line, sum(len(own)) AS n
  FROM l WHERE len(own) > 0 GROUP BY 1, 2, 3),
a AS (SELECT host, line, min(md5(text)) AS keeper FROM h GROUP BY 1, 2 HAVING count(*) > {LINE_LIMIT}),
gone AS (SELECT host, text FROM h LEFT JOIN a USING (host, line) GROUP BY 1, 2 HAVING 100 * sum(CASE WHEN keeper <> md5(text) THEN n ELSE 0 END) > {LOST_PERCENT} * sum(n)),
c AS (SELECT d.i, doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (i) LEFT JOIN rep USING (i)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND g.host IS NULL AS kept FROM f LEFT JOIN gone g ON g.host = f.host AND g.text = f.text
"""
