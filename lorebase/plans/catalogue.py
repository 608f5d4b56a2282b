"""Named queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import handle, tool
from ..functions import frontmatter, paths
from ..functions import sections as sectioning
from ..operators import index as indexing
from ..operators import prepare, search, segments, stats, suggest
from ..sources import documents as sources
from ..sources import shared, store
from ..streaming import upserts
from . import adapter, options

AS_OF = 1_740_000_000_000
QUERIES: dict = {}
ORACLES: dict = {}


def _index(spark: SparkSession, sf_dir: str) -> indexing.Index:
    return indexing.build(*adapter.tables(spark, sf_dir), adapter.wide(spark, sf_dir))


def _register(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _where_sql(o: options.Options) -> str:
    parts = ["true"]
    for name, column in (("types", "type"), ("statuses", "status"), ("trustTiers", "trust_tier"), ("conformance", "conformance")):
        if name in o.where:
            parts.append(f"{column} IN ({', '.join(map(_literal, o.where[name]))})")
    if "tagsAny" in o.where:
        values = ", ".join(map(_literal, o.where["tagsAny"]))
        parts.append(f"(source IN ({values}) OR lang IN ({values}))")
    if "stale" in o.where:
        due = f"coalesce(stale_after_epoch <= {o.as_of}, false)"
        parts.append(f"staleness_classified AND {'' if o.where['stale'] else 'NOT '}{due}")
    return " AND ".join(parts)


def _matches_sql(queries: dict[int, str], o: options.Options) -> str:
    rows = search.query_terms(queries, o)
    values = ", ".join(f"({q}, {p}, {_literal(t)}, {e}, {str(x).lower()}, {n})" for q, p, t, e, x, n in rows)
    fields = ", ".join(map(_literal, o.fields))
    begins = "q.prefix AND starts_with(w.term, q.term)" + (" AND q.edits = 0" if o.fuzzy_prefix else "")
    fuzzy = ""
    if o.fuzzy > 0:
        fuzzy = f" UNION ALL SELECT query_id, pos, n_terms, w.term, {search.FUZZY_WEIGHT} FROM words w JOIN q ON q.edits > 0 AND damerau_levenshtein(w.term, q.term) <= q.edits"
        if o.fuzzy_prefix:
            fuzzy += (f" UNION ALL SELECT query_id, pos, n_terms, w.term, {search.PREFIX_WEIGHT} FROM words w JOIN q ON q.edits > 0 AND q.prefix AND "
                      "list_min(list_transform(range(0, length(w.term) + 1), lambda k: damerau_levenshtein(q.term, left(w.term, CAST(k AS INTEGER))))) <= q.edits")  # fmt: skip
    return (
        adapter.INDEX_SQL
        + f""",
q(query_id, pos, term, edits, prefix, n_terms) AS (VALUES {values}),
words AS (SELECT DISTINCT term FROM term_stats WHERE field IN ({fields})),
allowed AS (SELECT * FROM postings WHERE field IN ({fields}) AND document_id IN (SELECT document_id FROM concepts WHERE {_where_sql(o)})),
alt AS (SELECT DISTINCT query_id, pos, n_terms, w.term, {search.PREFIX_WEIGHT} AS weight FROM words w JOIN q ON {begins}{fuzzy}),
found AS (SELECT query_id, section_id, document_id, n_terms, pos, p.field, p.term,
    ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * {search.K1 + 1}) / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avg_dl)) AS gain
  FROM allowed p JOIN q ON p.term = q.term JOIN term_stats s ON s.field = p.field AND s.term = p.term JOIN field_stats f ON f.field = p.field
  UNION ALL SELECT query_id, section_id, document_id, n_terms, pos, p.field, p.term, weight FROM allowed p JOIN alt a ON a.term = p.term),
best AS (SELECT query_id, section_id, document_id, n_terms, pos, field, max(gain) AS gain FROM found GROUP BY ALL),
scored AS (SELECT query_id, section_id, document_id, sum(CAST(gain * CASE field {' '.join(f"WHEN '{k}' THEN {v}" for k, v in o.boost.items())} END AS DECIMAL(28, 12))) AS score,
    array_to_string(list_sort(list(DISTINCT list_position([{fields}], field))), ',') AS places FROM best GROUP BY query_id, section_id, document_id, n_terms{' HAVING count(DISTINCT pos) = n_terms' if o.match == 'all' else ''})"""
    )


def _search_sql(queries: dict[int, str], o: options.Options) -> str:
    fields = ", ".join(map(_literal, o.fields))
    return f"""WITH {_matches_sql(queries, o)},
one AS (SELECT s.*, c.title, c.conformance, c.path, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, c.conformance <> 'strict', section_id) AS d FROM scored s JOIN concepts c USING (document_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conformance <> 'strict', section_id) AS rank FROM one WHERE d = 1)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, document_id, title, section_id, round(CAST(score AS DOUBLE), 6) AS score, conformance,
  array_to_string(list_transform(string_split(places, ','), lambda p: [{fields}][CAST(p AS INTEGER)]), ',') AS matched_fields, heading_path, path, start_line, end_line
FROM top JOIN secs USING (document_id, section_id) WHERE rank <= {o.limit}"""


def _flat(hits: DataFrame) -> DataFrame:
    return hits.withColumn("matched_fields", F.array_join("matched_fields", ",")).drop("snippet")


def _search(name: str, text: str | dict[int, str], given: dict | None = None) -> None:
    queries = text if isinstance(text, dict) else {0: text}
    o = options.validate(next(iter(queries.values())), {"asOf": AS_OF} | (given or {}))
    _register(name, lambda spark, sf_dir: _flat(search.search_many(_index(spark, sf_dir), queries, o)), _search_sql(queries, o))


_search("search_any_default", "the lichen pour")
_search("search_all", "the nd and", {"match": "all"})
_search("search_fields_title_body", "eaen the", {"fields": ["title", "body"]})
_search("search_boost_override", "the src3", {"boost": {"tags": 9.5, "title": 0.1}})
_search("search_limit_top3", "und der", {"limit": 3})
_search("search_prefix_final", "the lich")
_search("search_prefix_short_guard", "the li")
_search("search_fuzzy_d1", "lichn thhe", {"fuzzy": 0.2})
_search("search_fuzzy_d2", "ertionthe", {"fuzzy": True})
_search("filter_types", "the der", {"where": {"types": ["de", "fr"]}})
_search("filter_tags_any", "the der", {"where": {"tagsAny": ["src3", "es"]}})
_search("filter_statuses", "the", {"where": {"statuses": ["draft", "stable"]}})
_search("filter_trust", "the", {"where": {"trustTiers": ["human-reviewed"]}})
_search("filter_conformance", "the", {"where": {"conformance": ["degraded"]}})
_search("filter_stale_true", "the", {"where": {"stale": True}})
_search("filter_stale_false", "the", {"where": {"stale": False}})
_search("filter_as_of", "the", {"asOf": adapter.EPOCH + 400 * adapter.DAY, "where": {"stale": True}, "limit": 20})
_search("filter_combined", "the and", {"where": {"types": ["en"], "tagsAny": ["src0", "src1", "src2"], "statuses": ["stable"], "stale": False}, "limit": 25})
_search("filter_empty_noop", "the lichen", {"where": {"types": [], "tagsAny": [], "statuses": [], "trustTiers": [], "conformance": []}})
_search("collapse_best_section", "and the of", {"limit": 40})
_search("tie_break_strict_then_id", "en", {"fields": ["type"], "limit": 50})
_search("matched_fields", "src5 the en", {"fields": ["body", "tags", "type", "title", "heading"], "limit": 30})
_BATCH = {i: text for i, text in enumerate(["the and", "lichen", "und der die", "que los", "une pas", "src7 tion", "thonre hand", "euxier", "ciónes", "the"])}
_search("batch_search", _BATCH)


def _invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that match under a filter, and their sections whose score differs without it; all matches, no ranking."""
    o = options.validate("q", {"asOf": AS_OF})
    rows = search.query_terms({0: "the and"}, o)
    index = search.gathered(_index(spark, sf_dir), rows, o)  # for both searches

    def run(where):
        o = options.validate("q", {"asOf": AS_OF, "where": where})
        return search.scores(search.matches(index, rows, o), o).select("document_id", "section_id", "score")

    both = run({"types": ["en"]}).withColumnRenamed("score", "filtered").join(run({}).drop("document_id"), "section_id", "left")
    return both.agg(F.count_distinct("document_id").alias("compared"), F.count_if(~F.col("filtered").eqNullSafe(F.col("score"))).alias("changed"))


_WIDE = options.validate("q", {"asOf": AS_OF, "limit": 100_000, "where": {"types": ["en"]}})
_register("filter_score_invariance", _invariance, f"SELECT count(*) AS compared, CAST(0 AS BIGINT) AS changed FROM ({_search_sql({0: 'the and'}, _WIDE)})")


def _snippets(name: str, length: int) -> None:
    o = options.validate("q", {"asOf": AS_OF, "limit": 50, "snippetLength": length, "fields": ["body"]})
    _register(name, lambda spark, sf_dir: search.search_many(_index(spark, sf_dir), {0: "lichen"}, o).select("section_id", "snippet"), rf"""WITH hit AS ({_search_sql({0: 'lichen'}, o)}), base AS (WITH {adapter.SQL} SELECT section_id, text FROM secs),
a AS (SELECT section_id, text, length(regexp_extract(text, '(?is)^(.*?[^\p{{L}}\p{{N}}])??lichen', 0)) - 6 AS place FROM hit JOIN base USING (section_id)),
w AS (SELECT section_id, text, greatest(place - 80, 0) AS s FROM a)
SELECT section_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(text, s + 1, {length}), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN s + {length} < length(text) THEN '…' ELSE '' END AS snippet FROM w""")


_snippets("snippet_exact", 60)
_snippets("snippet_length", 25)


def _documents(build):
    return lambda spark, sf_dir: build(adapter.tables(spark, sf_dir)[0])


_C = f"WITH {adapter.SQL} "
_register("stats_documents", _documents(stats.totals), _C + "SELECT count(*) AS total, count(*) FILTER (conformance = 'strict') AS strict, count(*) FILTER (conformance = 'degraded') AS degraded FROM concepts")
_register("stats_types", _documents(stats.types), _C + "SELECT type, count(*) AS document_count FROM concepts GROUP BY type")
_register("stats_statuses", _documents(stats.statuses), _C + "SELECT count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'stable') AS stable, count(*) FILTER (status = 'deprecated') AS deprecated, count(*) FILTER (status IS NULL) AS unclassified FROM concepts")
_register("stats_trust", _documents(stats.trust_tiers), _C + "SELECT count(*) FILTER (trust_tier = 'unverified') AS unverified, count(*) FILTER (trust_tier = 'machine-confirmed') AS machine_confirmed, count(*) FILTER (trust_tier = 'human-reviewed') AS human_reviewed, count(*) FILTER (trust_tier IS NULL) AS unclassified FROM concepts")
_register("list_types", _documents(lambda d: d.select("type").distinct().orderBy("type")), _C + "SELECT DISTINCT type FROM concepts")
_register("list_degraded", _documents(stats.degraded), _C + "SELECT document_id, path FROM concepts WHERE conformance = 'degraded'")

_I = f"WITH {adapter.INDEX_SQL} "
_register("postings", lambda s, d: _index(s, d).postings.drop("strict"), _I + "SELECT field, term, section_id, document_id, CAST(dl AS INTEGER) AS dl, tf FROM postings")
_register("postings_df", lambda s, d: _index(s, d).term_stats, _I + "SELECT field, term, df FROM term_stats")
_register("field_stats", lambda s, d: _index(s, d).field_stats.withColumn("avg_dl", F.round("avg_dl", 6)), _I + "SELECT field, n_docs, round(avg_dl, 6) AS avg_dl FROM field_stats")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that deliberately broken documents and sections violate, with their numbers."""
    documents, sections = adapter.tables(spark, sf_dir)
    n = F.element_at(F.split("document_id", "/"), -1).cast("long")
    wrong = lambda k, value, c: F.when(n % k == 0, value).otherwise(F.col(c)).alias(c)
    changed = documents.where(n % 41 != 0).select(
        "document_id", wrong(23, F.lit(" "), "path"), wrong(11, F.lit(" "), "type"), "title", "tags", wrong(17, F.lit("weird"), "status"), wrong(19, F.lit("nobody"), "trust_tier"), wrong(35, F.lit(1).cast("long"), "stale_after_epoch"),
        "staleness_classified", F.when(n % 13 == 0, "odd").when(n % 49 == 0, "strict").otherwise(F.col("conformance")).alias("conformance"), "resource", "description", "source_text",
    )
    changed = changed.unionByName(changed.where(n % 29 == 0))
    cut = sections.where(n % 31 != 0).withColumn("start_line", F.when(n % 37 == 0, 0).otherwise(F.col("start_line")))
    return indexing.violations(changed, cut.unionByName(cut.where((n % 43 == 0) & (F.col("end_line") <= adapter.LINES)))).groupBy("rule").count()


_register("index_violations", _broken, _C + """, c AS (SELECT doc_id AS n, CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE document_id || '.md' END AS path, doc_id % 11 = 0 AS no_type, CASE WHEN doc_id % 17 = 0 THEN 'weird' WHEN doc_id % 4 < 3 THEN 'fine' END AS status,
  doc_id % 35 = 0 OR doc_id % 7 <> 0 AND doc_id % 3 <> 0 AS deadline, doc_id % 7 <> 0 AS classified, CASE WHEN doc_id % 13 = 0 THEN 'odd' WHEN doc_id % 49 = 0 THEN 'strict' WHEN doc_id % 4 = 3 OR doc_id % 7 = 0 THEN 'degraded' ELSE 'strict' END AS conformance FROM docs WHERE doc_id % 41 <> 0),
d AS (FROM c UNION ALL FROM c WHERE n % 29 = 0), x AS (SELECT doc_id AS n, section_id, start_line, end_line FROM secs JOIN docs USING (document_id) WHERE doc_id % 31 <> 0), y AS (FROM x UNION ALL FROM x WHERE n % 43 = 0 AND end_line <= 10),
v AS (SELECT 'blank path' AS rule FROM d WHERE path = ' ' UNION ALL SELECT 'blank type' FROM d WHERE no_type UNION ALL SELECT 'unknown conformance' FROM d WHERE conformance = 'odd' UNION ALL SELECT 'strict but unclassified' FROM d WHERE conformance = 'strict' AND (status IS NULL OR NOT classified)
UNION ALL SELECT 'unclassified with a deadline' FROM d WHERE NOT classified AND deadline UNION ALL SELECT 'unknown status' FROM d WHERE status = 'weird' UNION ALL SELECT 'unknown trust tier' FROM d WHERE n % 19 = 0
UNION ALL SELECT 'repeated document_id' FROM d GROUP BY n HAVING count(*) > 1 UNION ALL SELECT 'repeated path' FROM d GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'repeated section_id' FROM y GROUP BY section_id HAVING count(*) > 1
UNION ALL SELECT 'bad lines' FROM y WHERE n % 37 = 0 UNION ALL SELECT 'no section' FROM d WHERE n % 31 = 0 UNION ALL SELECT 'no document' FROM y WHERE n % 41 = 0)
SELECT rule, count(*) AS count FROM v GROUP BY rule""")  # fmt: skip


_register("postings_blocks", lambda s, d: indexing.decoded(store.blocks(_index(s, d))).drop("strict"), ORACLES["postings"])


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of searches, pruned whatever the number of postings."""
    index, o = store.stored(_index(spark, sf_dir), fuzzy=False), options.validate("q", {"asOf": AS_OF})
    rows = search.query_terms(_BATCH, o)
    frame, met = search.expand(index, rows, o)
    return _flat(search.hits(index, search.ranked(search.scores(search.pruned(index, met, o, frame), o), o), rows, o))


_register("batch_search_pruned", _pruned, ORACLES["batch_search"])


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    # the frequencies are what is held, by part of the terms; the postings stream past them and are not sorted
    rows = i.postings.where("field = 'body'").join(i.term_stats.where("field = 'body'").hint("shuffle_hash"), ["field", "term"]).join(F.broadcast(i.field_stats), "field")
    return rows.select("term", "section_id", F.round(search.bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avg_dl")), 6).alias("bm25"))


_register("bm25_components", _bm25, _I + f"SELECT term, section_id, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * {search.K1 + 1}) / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avg_dl)), 6) AS bm25 FROM postings JOIN term_stats USING (field, term) JOIN field_stats USING (field) WHERE field = 'body'")


def _suggest(name: str, text: str, given: dict) -> None:
    o = options.validate(text, {"asOf": AS_OF} | given, suggest=True)
    oracle = f"""WITH {_matches_sql({0: text}, o)},
w AS (SELECT section_id, pos, list_reverse_sort(list(DISTINCT term)) AS words FROM found GROUP BY section_id, pos),
p AS (SELECT section_id, flatten(list(words ORDER BY pos)) AS all_terms FROM w GROUP BY section_id),
u AS (SELECT section_id, list_filter(all_terms, lambda t, i: list_position(all_terms, t) = i) AS terms FROM p)
SELECT array_to_string(terms, ' ') AS suggestion, array_to_string(terms, ',') AS terms, round(CAST(avg(score) AS DOUBLE), 6) AS score FROM scored JOIN u USING (section_id) GROUP BY terms ORDER BY score DESC, suggestion LIMIT {o.limit}"""
    _register(name, lambda s, d: suggest.suggest(_index(s, d), text, o).withColumn("terms", F.array_join("terms", ",")), oracle)


_suggest("suggest_prefix", "the th", {"fields": ["title", "heading"]})
_suggest("suggest_filtered", "und", {"fields": ["heading"], "where": {"types": ["de"], "statuses": ["stable", "draft"]}, "limit": 5})
_suggest("suggest_mean_score", "s", {"fields": ["tags"]})


def _documents_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_register("normalize_paths",
    lambda s, d: _documents_table(s, d).select("doc_id", paths.normalized(F.concat(F.element_at(F.array(*map(F.lit, ["./", "a//", "../", "/", "x/./y/", ""])), (F.col("doc_id") % 6 + 1).cast("int")), F.concat_ws("-", "source", "lang"), F.element_at(F.array(*map(F.lit, [".md", ".MD", "/index.md", "/.", ".md"])), (F.col("doc_id") % 5 + 1).cast("int")))).alias("n")).select("doc_id", "n.path", "n.document_id", "n.error_path"),
    """WITH p AS (SELECT doc_id, (['./', 'a//', '../', '/', 'x/./y/', ''])[CAST(doc_id % 6 + 1 AS INTEGER)] || source || '-' || lang || (['.md', '.MD', '/index.md', '/.', '.md'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS p FROM documents),
n AS (SELECT doc_id, p, array_to_string(list_filter(string_split(p, '/'), lambda s: s NOT IN ('', '.')), '/') AS k FROM p),
e AS (SELECT doc_id, k, CASE WHEN starts_with(p, '/') OR starts_with(p, '../') OR ends_with(p, '/.') THEN '<input>' WHEN NOT ends_with(k, '.md') OR ends_with(k, '/index.md') THEN k END AS error_path FROM n)
SELECT doc_id, CASE WHEN error_path IS NULL THEN k END AS path, CASE WHEN error_path IS NULL THEN left(k, length(k) - 3) END AS document_id, error_path FROM e""")  # fmt: skip
_register("fallback_title",
    lambda s, d: _documents_table(s, d).select("doc_id", paths.titled(F.concat_ws("/", "source", F.concat_ws("--_", "lang", F.substring_index("text", " ", 1), F.col("doc_id").cast("string")))).alias("title")),
    "WITH t AS (SELECT doc_id, regexp_replace(list_last(string_split(source || '/' || lang || '--_' || string_split(text, ' ')[1] || '--_' || doc_id, '/')), '[-_]+', ' ', 'g') AS w FROM documents) SELECT doc_id, upper(left(w, 1)) || substr(w, 2) AS title FROM t")
_register("parse_timestamps",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", frontmatter.timestamp_millis(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, ["Z", ".1Z", ".1230Z", ".0009Z", "+05:30", "-23:59", " Z", "+24:00"])), (F.col("event_id") % 8 + 1).cast("int")))).alias("epoch_millis")),
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN m WHEN 1 THEN m + 100 WHEN 2 THEN m + 123 WHEN 3 THEN m + 1 WHEN 4 THEN m - 19800000 WHEN 5 THEN m + 86340000 END AS epoch_millis
FROM (SELECT event_id, epoch_ms(date_trunc('second', ts)) AS m FROM events)""")  # fmt: skip
_register("actor_predicate",
    lambda s, d: _documents_table(s, d).select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, ["human:", "process:", "team:", "tools/", "a/b/", "human: ", ""])), (F.col("doc_id") % 7 + 1).cast("int")), "source").rlike(frontmatter.ACTOR).alias("is_actor")),
    "SELECT doc_id, doc_id % 7 IN (0, 1, 3) AS is_actor FROM documents")


def _by_row(run, kind: str):
    """A function of one text as a column function; null stays null."""

    @F.pandas_udf(kind)
    def out(texts: pd.Series) -> pd.Series:
        return texts.map(run, na_action="ignore")

    return out


_register("word_count",
    lambda s, d: _documents_table(s, d).select("doc_id", sectioning.counted_words(F.coalesce("text", F.lit(""))).alias("words")),
    r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS BIGINT) AS words FROM documents")
_register("text_normalize",
    lambda s, d: _documents_table(s, d).select("doc_id", F.md5(sectioning.cleaned(F.concat(F.lit(" \r\n\u3000"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\t \r")))).alias("text")),
    "SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text FROM documents")


def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the slugs of whole texts, numbered within each source."""
    rows = _documents_table(spark, sf_dir).select("doc_id", "source", _by_row(sectioning.slug, "string")(F.concat(F.lit("--"), F.coalesce("text", F.lit("")), F.lit("_"))).alias("slug"))
    n = F.row_number().over(Window.partitionBy("source", "slug").orderBy("doc_id"))
    return rows.select("doc_id", F.concat(F.md5("slug"), F.when(n > 1, F.concat(F.lit("--"), n.cast("string"))).otherwise("")).alias("slug"))


_register("slugs_unique", _slugs, r"""WITH c AS (SELECT doc_id, source, array_to_string(list_transform(string_split(lower(coalesce(text, '')), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || '-' ELSE c END), '') AS t FROM documents),
s AS (SELECT doc_id, source, coalesce(nullif(trim(regexp_replace(t, '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'section') AS slug FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id) AS n FROM s) SELECT doc_id, md5(slug) || CASE WHEN n > 1 THEN '--' || n ELSE '' END AS slug FROM n""")
_register("token_cap",
    lambda s, d: _documents_table(s, d).select("doc_id", F.size(options.tokenized(F.concat(F.repeat(F.lit("a"), (F.lit(options.MAX_TERM - 9) + F.col("doc_id") % 20).cast("int")), F.lit(" b")))).alias("terms")),
    f"SELECT doc_id, CAST(CASE WHEN doc_id % 20 <= 9 THEN 2 ELSE 1 END AS INTEGER) AS terms FROM documents")


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a browser gives them: a chosen folder before each path, byte-order marks, invalid UTF-8, other files."""
    n = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, ["a.md", "index.md", "b.MD", "log.md"])), F.when(n % 10 < 7, 1).otherwise(n % 10 - 5).cast("int"))
    content = F.concat(F.unhex(F.when(n % 3 == 0, "EFBBBF").when(n % 5 == 0, "FF").otherwise("")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    files = _documents_table(spark, sf_dir).select(F.concat(F.lit("chosen/"), n.cast("string"), F.lit("/"), name).alias("path"), content.alias("content"))
    return sources.uploads(files).select("path", F.md5("markdown").alias("markdown"))


_register("source_uploads", _uploaded, "SELECT doc_id || '/a.md' AS path, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 <> 0 THEN md5(coalesce(text, '')) END AS markdown FROM documents WHERE doc_id % 10 < 7")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.regexp_extract("markdown", frontmatter.ENVELOPE, k)
    head = F.length("markdown") - F.length(part(2))
    line = F.regexp_count(F.substring(F.col("markdown"), F.lit(1), head), F.lit("\n")) + 1
    return adapter.rendered(spark, sf_dir).select("path", part(1).alias("yaml"), line.alias("body_line"))


_R = f"WITH {adapter.RENDERED_SQL} "
_register("frontmatter_split", _split, _R + "SELECT path, yaml, CAST(8 AS INTEGER) AS body_line FROM heads")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = prepare.split(prepare.prepare(adapter.rendered(spark, sf_dir)))
    return documents.select("document_id", "path", "type", "title", F.array_join("tags", ",").alias("tags"), "resource", "status", "trust_tier", "conformance", F.array_join(F.transform("diagnostics", lambda d: d["field"]), ",").alias("wrong"))


_register("prepare_roundtrip", _round_trip, _C + """SELECT document_id, path, type, title, source || ',' || lang AS tags, resource, status, 'unverified' AS trust_tier,
  CASE WHEN status IS NULL THEN 'degraded' ELSE 'strict' END AS conformance, CASE WHEN status IS NULL THEN 'status' ELSE '' END AS wrong FROM concepts""")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = prepare.split(prepare.prepare(adapter.rendered(spark, sf_dir)))
    name = F.regexp_replace("section_id", "--part-[0-9]+$", "")
    rows = found.groupBy(name.alias("section_id"), "document_id", "heading_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda s: s["text"]), "\n\n").alias("text"), F.min("start_line").alias("start_line"))
    return rows.withColumn("text", F.md5(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))


_register("sections", _sections, _R + r"""SELECT document_id || '#part-' || part || CASE WHEN nth > 1 THEN '--' || nth ELSE '' END AS section_id, document_id, 'Part ' || part AS heading_path,
  md5(trim(regexp_replace(array_to_string(list_transform(own, lambda l: 'x ' || l), chr(10) || chr(10)), '[\x20\x09-\x0D]+', ' ', 'g'))) AS text,
  CAST(8 + 2 * 11 * s AS INTEGER) AS start_line FROM parts""")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = prepare.split(prepare.prepare(adapter.rendered(spark, sf_dir)))
    return found.select("section_id", "start_line", "end_line", F.size(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("words"))


_register("chunks_800_500_250", _chunks, f"WITH RECURSIVE {adapter.RENDERED_SQL}" + r""",
blocks AS (SELECT document_id, s, part, nth, j, len(regexp_extract_all('x ' || own[j], '[\p{L}\p{N}_]+')) AS w, sum(len(regexp_extract_all('x ' || own[j], '[\p{L}\p{N}_]+'))) OVER (PARTITION BY document_id, s) AS total FROM parts, unnest(range(1, len(own) + 1)) AS r(j)),
fold(document_id, s, j, chunk, held) AS (SELECT document_id, s, j, 1, w FROM blocks WHERE j = 1 UNION ALL
  SELECT b.document_id, b.s, b.j, CASE WHEN total > 800 AND held + w > 500 THEN chunk + 1 ELSE chunk END, CASE WHEN held + w > 500 THEN w ELSE held + w END FROM fold f JOIN blocks b ON b.document_id = f.document_id AND b.s = f.s AND b.j = f.j + 1),
cuts AS (SELECT document_id, s, part, nth, b.j, w, chunk, max(chunk) OVER (PARTITION BY document_id, s) AS last_chunk, sum(w) OVER (PARTITION BY document_id, s, chunk) AS own_words FROM fold JOIN blocks b USING (document_id, s, j)),
made AS (SELECT *, CASE WHEN chunk = last_chunk AND chunk > 1 AND own_words < 250 THEN chunk - 1 ELSE chunk END AS k FROM cuts),
n AS (SELECT *, max(k) OVER (PARTITION BY document_id, s) AS n FROM made)
SELECT document_id || '#part-' || part || CASE WHEN nth > 1 THEN '--' || nth ELSE '' END || CASE WHEN n > 1 THEN '--part-' || k ELSE '' END AS section_id,
  CAST(CASE WHEN k = 1 THEN 8 + 22 * s ELSE 8 + 22 * s + 2 * min(j) END AS INTEGER) AS start_line, CAST(8 + 22 * s + 2 * max(j) AS INTEGER) AS end_line, CAST(sum(w) AS INTEGER) AS words FROM n GROUP BY document_id, s, part, nth, n, k""")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["---\ntype: A\n---\n", "---\ntype: A\nstatus: x\n---\n", "no envelope", "---\ntitle: t\n---\n", "---\ntype: A\n---\n"]))
    n = F.col("doc_id")
    rows = _documents_table(spark, sf_dir).select(F.concat(F.when(n % 5 == 4, "../").otherwise(""), F.lit("d/"), n.cast("string"), F.lit(".md")).alias("path"), F.concat(F.element_at(kinds, (n % 5 + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("markdown"))
    return prepare.validate(rows).groupBy("is_valid", "is_indexable", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["field"])), ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


_register("validate_outcomes", _outcomes, """SELECT k = 0 AS is_valid, k < 2 AS is_indexable, (['', 'ERR_FIELD:status', 'ERR_PARSE', 'ERR_FIELD:type', 'ERR_FIELD:path'])[k + 1] AS errors, count(*) AS n
FROM (SELECT CAST(doc_id % 5 AS INTEGER) AS k FROM documents) GROUP BY k""")


def _handle(spark: SparkSession, sf_dir: str) -> tuple[handle.ConceptSearch, str]:
    found = handle.ConceptSearch(_index(spark, sf_dir))
    return found, found.documents.agg(F.min("path")).first()[0]


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, path = _handle(spark, sf_dir)
    found.ingest(path, "---\ntype: Replaced\ntitle: New\n---\nnothing else\n")
    return found.documents.select("document_id", "type", "title").join(found.sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections")), "document_id")


_register("ingest_replace", _replaced, _C + """SELECT document_id, CASE WHEN first THEN 'Replaced' ELSE type END AS type, CASE WHEN first THEN 'New' ELSE title END AS title, CASE WHEN first THEN 1 ELSE n END AS sections
FROM (SELECT *, document_id || '.md' = min(document_id || '.md') OVER () AS first FROM concepts JOIN (SELECT document_id, count(*) AS n FROM secs GROUP BY document_id) USING (document_id))""")


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, path = _handle(spark, sf_dir)
    found.remove(path)
    return found.documents.select("document_id", "path")


_register("remove_document", _removed, _C + "SELECT document_id, path FROM concepts WHERE path <> (SELECT min(path) FROM concepts)")


def _two_segments(spark: SparkSession, sf_dir: str) -> indexing.Index:
    """An index of two segments: every third document was ingested anew, as it was, and every fifth is gone."""
    documents, sections = adapter.tables(spark, sf_dir)
    wide = adapter.wide(spark, sf_dir)
    number = F.element_at(F.split("document_id", "/"), -1).cast("long")
    # asked once, for what needs no stored postings
    first = segments.planned(indexing.build(documents, sections, wide))
    again = segments.planned(indexing.build(documents.where(number % 3 == 0), sections.where(number % 3 == 0), wide.where(number % 3 == 0)))
    parts = segments.changed([first], documents.where((number % 3 == 0) | (number % 5 == 0)).select("document_id"), again)
    parts = segments.changed(parts, documents.where(number % 5 == 0).select("document_id"), None)
    return segments.combined(parts)


_register("segments_inventory", lambda s, d: _two_segments(s, d).inventory, _C + ", left_ AS (SELECT * FROM concepts WHERE CAST(list_last(string_split(document_id, '/')) AS BIGINT) % 5 <> 0) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, CAST(count(*) AS BIGINT) AS n FROM left_ GROUP BY {k}" for k in stats.KINDS))
_register("segments_df", lambda s, d: _two_segments(s, d).term_stats.select("field", "term", "df"), _I + "SELECT field, term, count(*) AS df FROM postings WHERE CAST(list_last(string_split(document_id, '/')) AS BIGINT) % 5 <> 0 GROUP BY field, term")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of users after a stream of their events as versions, in files whose order is not that of the versions."""
    n, at = F.col("event_id"), shared.folder(spark)
    text = F.when(n % 13 != 5, F.concat(F.lit("---\ntype: "), "event_type", F.lit("\ntitle: v"), n.cast("string"), F.lit("\n---\nseen\n")))
    path = F.when(n % 97 == 0, "../out.md").otherwise(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null").select(path.alias("path"), text.alias("markdown"), n.alias("version"))
    for k in (2, 0, 1):
        rows.where(F.col("version") % 3 == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    found = handle.create_search(rows.select("path", "markdown").where("false"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    upserts.start(found, stream, f"{at}/progress").awaitTermination()
    return found.documents.select("path", "type", "title")


_register("stream_upserts", _streamed, """WITH e AS (SELECT 'u/' || user_id || '.md' AS path, event_id, event_type, event_id % 13 = 5 AS gone FROM events WHERE user_id IS NOT NULL AND event_id % 97 <> 0),
l AS (SELECT path, max(event_id) AS version, arg_max(event_type, event_id) AS type, arg_max(gone, event_id) AS gone FROM e GROUP BY path) SELECT path, type, 'v' || version AS title FROM l WHERE NOT gone""")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.folder(spark)
    handle.ConceptSearch(_index(spark, sf_dir)).save(at)
    o = options.validate("q", {"asOf": AS_OF})
    return _flat(search.search_many(store.load(spark, at), {0: "the lichen pour"}, o))


_register("cache_roundtrip", _cached, ORACLES["search_any_default"])


def _tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tool.tool_search(handle.ConceptSearch(_index(spark, sf_dir)), "/concepts", "the lichen", fuzzy=False)
    return spark.createDataFrame([(tool.render(hits),)], "text string")


_register("tool_search_text", _tool, None)
