"""Registered queries of the retrieval library over the given tables, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import adapters as A
from .functions import numbers as N
from .functions import textnorm as X
from .functions import vectors as V
from .operators import chats as C
from .operators import chunking as K
from .operators import context as G
from .operators import embedding as E
from .operators import events as H
from .operators import feed as P
from .operators import postings as I
from .operators import ranking as R
from .operators import tables as U
from .plans import search as S
from .plans.refresh import current, publish
from .sources.readers import extract_pages, read_documents, read_feed, read_results, read_tables, shared_folder, write_results
from .streaming.jobs import incremental_refresh, stream_assemble_turns, stream_feed_upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The adapters' arithmetic in SQL.
_DECISIONS = rf"""
raw_decisions AS (
  SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN '{A.PRIMARY}' ELSE '{A.OLD}' END ||
    CASE WHEN doc_id % 97 = 0 THEN 'scan-' || doc_id || '.pdf' ELSE 'Apofasi-' ||
      CASE WHEN doc_id % 20 <= 13 THEN '' WHEN doc_id % 20 <= 16 THEN 'A' WHEN doc_id % 20 = 17 THEN 'E' WHEN doc_id % 20 = 18 THEN 'AA' ELSE 'Α' END
      || (doc_id % 1500 + 1) || '-' || (2016 + doc_id % 10) || '.pdf' END AS pdf_url
  FROM documents
), decisions AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id,
    translate(upper(regexp_extract(pdf_url, '(?i)Apofasi[-_]([A-Za-zΑ-Ωα-ω]{{0,2}}[0-9]{{1,5}})[-_][0-9]{{4}}\.pdf', 1)), '{N.GREEK}', '{N.LATIN}') AS number,
    regexp_extract(pdf_url, '(?i)Apofasi[-_][A-Za-zΑ-Ωα-ω]{{0,2}}[0-9]{{1,5}}[-_]([0-9]{{4}})\.pdf', 1) AS year,
    CASE lang WHEN 'fr' THEN 'ΟΡΙΣΤΙΚΗ' WHEN 'de' THEN 'ΠΡΟΣΩΡΙΝΗ' WHEN 'es' THEN 'ΑΝΑΣΤΟΛΗ' ELSE '' END AS dtype, pdf_url,
    CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'no_text' WHEN 2 THEN 'embedded' ELSE 'error' END AS status,
    n_chars AS text_chars, doc_id % 7 AS n_chunks
  FROM raw_decisions
)"""
_INT = "coalesce(try_cast(nullif(regexp_extract({0}, '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER), 0)"
_FLAT = "trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x0b\\x85\\p{Z}]+', ' ', 'g'), ' ')"
_WINDOWS = f"""flat AS (SELECT CAST(doc_id AS VARCHAR) AS decision_id, {_FLAT} AS t FROM documents), windows AS (
  SELECT decision_id, i AS pos, substring(t, i * 1200 + 1, 1400) AS text FROM (
    SELECT decision_id, t, unnest(range(CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1400 THEN 1 ELSE CAST(ceil((length(t) - 1400) / 1200.0) AS BIGINT) + 1 END)) AS i FROM flat)
), numbered AS (
  SELECT decision_id, row_number() OVER (PARTITION BY decision_id ORDER BY pos) - 1 AS idx, text FROM windows WHERE length(trim(text, ' ')) >= 40
)"""
_CHUNKS = f"""{_WINDOWS}, chunks AS (
  SELECT decision_id, idx, embedding AS vec, text
  FROM numbered JOIN embeddings ON vec_id = (CAST(decision_id AS BIGINT) * 7 + idx) % (SELECT count(*) FROM embeddings)
)"""
_QUERIES = """
asked AS (
  SELECT item_id AS query_id, embedding AS vec, text ||
    CASE WHEN item_id % 4 = 0 AND number IS NOT NULL THEN ' ' || number || '/' || year ELSE '' END AS text
  FROM benchmark LEFT JOIN embeddings ON vec_id = (item_id * 7) % (SELECT count(*) FROM embeddings)
  LEFT JOIN decisions ON id = CAST(item_id * 3 AS VARCHAR)
)"""
_CHATS = """
chats AS (
  SELECT conv_id AS id, 'chat ' || conv_id AS title, CASE WHEN conv_id % 5 <> 0 THEN 'u' || conv_id % 7 END AS owner,
    1704067200 + conv_id * 60 + max(turn) AS updated_s FROM conversations GROUP BY conv_id
), messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id, role, text AS content, 1704067200 + conv_id * 60 + turn AS at_s FROM conversations
)"""
_FOLD = f"translate(upper({{0}}), '{N.GREEK}', '{N.LATIN}')"
_NORM = "replace(lower(strip_accents({0})), 'ς', 'σ')"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(" + _NORM + ", '[^0-9a-zα-ω]+'), lambda t: length(t) >= 3))"
# Each character that is no word character is doubled, so that neighbouring numbers don't share one.
_NUMBERS = r"list_distinct(regexp_extract_all(' ' || regexp_replace({0}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ', '[^\p{{L}}\p{{N}}_]([0-9]{{1,5}})[^\p{{L}}\p{{N}}_]', 1))"
_REF = r"'[^\p{{L}}\p{{N}}_]([A-Za-zΑ-Ωα-ω]{{0,2}}[0-9]{{1,5}})\s*/\s*((?:19|20)[0-9]{{2}})[^\p{{L}}\p{{N}}_]'"
_REFS = "list_zip(regexp_extract_all(' ' || {0} || ' ', " + _REF + ", 1), regexp_extract_all(' ' || {0} || ' ', " + _REF + ", 2))"
_SIM = """
units AS (
  SELECT decision_id, idx, text, list_transform(vec, lambda x: x::DOUBLE / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS vec
  FROM (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunks)
), asked_units AS (
  SELECT query_id, text, list_transform(vec, lambda x: x::DOUBLE / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS vec
  FROM (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM asked)
), sims AS (
  SELECT query_id, decision_id, idx, q.text AS query, c.text AS text, round(list_dot_product(q.vec, c.vec), 12) AS sim FROM asked_units q, units c
)"""


def _pooled(pool: int) -> str:
    return f"""
pooled AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, decision_id, idx) AS n FROM sims) WHERE n <= {pool}
), refs AS (
  SELECT DISTINCT query_id, id AS decision_id FROM (SELECT query_id, unnest({_REFS.format("text")}) AS r FROM asked)
  JOIN decisions ON number <> '' AND decisions.year <> '' AND number = {_FOLD.format("r[1]")} AND decisions.year = r[2]
), forced AS (
  SELECT query_id, decision_id, idx, sim, sim + 1.0 AS score, true AS forced
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, decision_id ORDER BY sim DESC, idx) AS m FROM sims SEMI JOIN refs USING (query_id, decision_id)) WHERE m = 1
), loose AS (
  SELECT query_id, decision_id, idx, sim, round(sim + 0.03 * len(list_filter({_TOKENS.format("query")}, lambda t: contains({_NORM.format("text")}, t)))
    + CASE WHEN list_contains({_NUMBERS.format("query")}, regexp_replace(coalesce(number, ''), '[^0-9]', '', 'g')) THEN 0.25 ELSE 0.0 END, 12) AS score, false AS forced
  FROM pooled LEFT JOIN decisions ON decision_id = decisions.id
), scored AS (
  SELECT * FROM loose ANTI JOIN forced USING (query_id, decision_id, idx) UNION ALL SELECT * FROM forced
)"""


def _best(k: int) -> str:
    return f"""
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, decision_id, idx) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, decision_id ORDER BY score DESC, sim DESC, idx) AS m FROM scored) WHERE m = 1
  QUALIFY rank <= {k}
)"""


_SEARCH = f"WITH {_DECISIONS}, {_CHUNKS}, {_QUERIES}, {_SIM}"


def _query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_FOLDERS: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, d: str) -> str:
    """Where the first search of a session has stored the index, queries and decisions of the given tables, for all of them."""
    key = spark.sparkContext.applicationId, d
    if key not in _FOLDERS:
        folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
        A.queries(spark, d).write.parquet(f"{folder}/queries")
        A.decisions(spark, d).write.parquet(f"{folder}/decisions")
        I.build_index(A.chunks(spark, d), folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _search_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, I.Index, DataFrame]:
    folder = _folder(spark, d)
    return spark.read.parquet(f"{folder}/queries"), I.open_index(spark, folder), spark.read.parquet(f"{folder}/decisions")


# --- search -----------------------------------------------------------------------------------------------------

@_query("search_index", f"WITH {_WINDOWS} SELECT decision_id, idx, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS tokens FROM numbered")
def _(spark, d):
    index = _search_inputs(spark, d)[1]
    return index.postings.select("decision_id", F.col("idx").cast("long").alias("idx"), F.array_join(F.array_sort(F.filter(F.split("tokens", " "), lambda t: t != "")), " ").alias("tokens"))


_SNIPPET = "CASE WHEN length({0}) > 320 THEN regexp_replace(substring({0}, 1, 320), '(?s) [^ ]*$', '') || '…' ELSE {0} END"
_TITLE = "'Απόφαση ' || number || '/' || year || CASE WHEN dtype <> '' THEN ' — ' || dtype ELSE '' END"
_SEARCH_SQL = f"""{_SEARCH}, {_pooled(200)}, {_best(8)}
SELECT query_id, asked.text AS query, rank, decision_id, number, year, dtype AS type, pdf_url, round(score, 4) AS score,
  {_SNIPPET.format("chunks.text")} AS snippet, {_TITLE} AS title
FROM best JOIN chunks USING (decision_id, idx) JOIN decisions ON decisions.id = decision_id JOIN asked USING (query_id)"""


@_query("search", _SEARCH_SQL)
def _(spark, d):
    return S.search(*_search_inputs(spark, d))


_TOP_SQL = f"""{_SEARCH}, {_pooled(250)}, {_best(10)}
SELECT query_id, asked.text AS query, rank, decision_id, number, year, dtype AS type, pdf_url, score, chunks.text AS text, {_TITLE} AS title
FROM best JOIN chunks USING (decision_id, idx) JOIN decisions ON decisions.id = decision_id JOIN asked USING (query_id)"""


@_query("top_chunks", _TOP_SQL)
def _(spark, d):
    return S.top_chunks(*_search_inputs(spark, d))


@_query("rank_chunks", f"{_SEARCH}, {_pooled(200)} SELECT query_id, decision_id, idx, sim, score, forced FROM scored")
def _(spark, d):
    return R.rank_chunks(*_search_inputs(spark, d))


@_query("best_per_decision", f"{_SEARCH}, {_pooled(60)}, {_best(5)} SELECT query_id, decision_id, idx, sim, score, forced, rank FROM best")
def _(spark, d):
    return R.best_per_decision(R.rank_chunks(*_search_inputs(spark, d), pool=60), 5)


_FORCE_SQL = f"""{_SEARCH}, {_pooled(20)}, given AS (
  SELECT query_id, decision_id, idx, sim, sim AS score, false AS forced FROM sims WHERE idx < 2
) SELECT * FROM given ANTI JOIN forced USING (query_id, decision_id, idx) UNION ALL SELECT query_id, decision_id, idx, sim, score, forced FROM forced"""


@_query("force_refs", _FORCE_SQL)
def _(spark, d):
    """Scored are all pairs with chunks of the first two places, so that forced chunks replace entries."""
    q, c, m = _search_inputs(spark, d)
    first = I.Index(c.vectors.where("idx < 2"), c.texts)
    scored = R.similarities(q, first).select("query_id", "decision_id", "idx", "sim", F.col("sim").alias("score"), F.lit(False).alias("forced"))
    return R.force_refs(scored, R.match_refs(q, m), q, c).withColumn("idx", F.col("idx").cast("long"))


@_query("match_refs", f"{_SEARCH}, {_pooled(1)} SELECT query_id, decision_id FROM refs")
def _(spark, d):
    q, _c, m = _search_inputs(spark, d)
    return R.match_refs(q, m)


@_query("vector_topn", f"{_SEARCH}, {_pooled(20)} SELECT query_id, decision_id, idx, sim FROM pooled")
def _(spark, d):
    q, c, _m = _search_inputs(spark, d)
    return R.vector_topn(q, c, 20)


_TARGETS = "SELECT item_id AS query_id, CAST(unnest([item_id * 3, item_id * 5 + 1]) AS VARCHAR) AS decision_id FROM benchmark"
_TARGET_SQL = f"""{_SEARCH}, wanted AS ({_TARGETS}), tops AS (
  SELECT query_id, decision_id, max(sim) AS best FROM sims SEMI JOIN wanted USING (query_id, decision_id) GROUP BY ALL
) SELECT t.query_id, t.decision_id, count(*) FILTER (s.sim > t.best) + 1 AS target_rank FROM tops t JOIN sims s USING (query_id) GROUP BY ALL"""


@_query("target_rank", _TARGET_SQL)
def _(spark, d):
    q, c, _m = _search_inputs(spark, d)
    wanted = F.explode(F.array((F.col("query_id") * 3).cast("string"), (F.col("query_id") * 5 + 1).cast("string")))
    return R.target_rank(q, c, q.select("query_id", wanted.alias("decision_id")))


_KEYWORD_SQL = f"""{_SEARCH}, {_pooled(100)}
SELECT query_id, decision_id, idx, len(list_filter({_TOKENS.format("query")}, lambda t: contains({_NORM.format("text")}, t))) AS hits,
  CASE WHEN list_contains({_NUMBERS.format("query")}, regexp_replace(number, '[^0-9]', '', 'g')) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS boost
FROM pooled JOIN decisions ON decision_id = decisions.id"""


@_query("keyword_and_number", _KEYWORD_SQL)
def _(spark, d):
    q, c, m = _search_inputs(spark, d)
    asked = q.select("query_id", X.search_tokens(F.col("text")).alias("tokens"))
    rows = I.token_hits(R.vector_topn(q, c, 100), asked, c).join(q.select("query_id", X.query_numbers(F.col("text")).alias("numbers")), "query_id").join(m.select(F.col("id").alias("decision_id"), "number"), "decision_id")
    return rows.select("query_id", "decision_id", "idx", F.col("hits").cast("long").alias("hits"), R.number_boost(F.col("numbers"), F.col("number")).alias("boost"))


_JSON_SQL = f"""{_SEARCH}, {_pooled(200)}, {_best(8)}
SELECT asked.text AS query, count(*) AS n_results, string_agg(concat_ws('|', number, year, dtype, pdf_url, CAST(round(score * 10000) AS BIGINT), {_SNIPPET.format("chunks.text")}, {_TITLE}), chr(10) ORDER BY rank) AS results
FROM best JOIN chunks USING (decision_id, idx) JOIN decisions ON decisions.id = decision_id JOIN asked USING (query_id) GROUP BY asked.text"""


@_query("results_json", _JSON_SQL)
def _(spark, d):
    hit = lambda h: F.concat_ws("|", h["number"], h["year"], h["type"], h["pdf_url"], F.round(h["score"] * 10000).cast("long"), h["snippet"], h["title"])
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    write_results(S.search(*_search_inputs(spark, d)), path)
    return read_results(spark, path).select("query", F.size("results").cast("long").alias("n_results"), F.array_join(F.transform("results", hit), "\n").alias("results"))


# --- numbers and feed -------------------------------------------------------------------------------------------

@_query("number_year_from_url", f"WITH {_DECISIONS} SELECT id, number, year FROM decisions")
def _(spark, d):
    return A.decisions(spark, d).select("id", N.number_year_from_url(F.col("pdf_url")).alias("n")).select("id", "n.number", "n.year")


@_query("normalize_number", f"SELECT doc_id, {_FOLD.format("trim(replace(text, 'ß', 'ss'), ' ' || chr(9) || chr(10) || chr(13))")} AS number, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", N.normalize_number(F.col("text")).alias("number"), N.digits_of(F.col("text")).alias("digits"))


@_query("number_shape_profile", rf"WITH {_DECISIONS} SELECT CASE WHEN regexp_matches(pdf_url, 'Apofasi-') THEN regexp_extract(pdf_url, 'Apofasi-([A-ZΑ-Ω]*)[0-9]', 1) ELSE 'unparseable' END AS shape, count(*) AS n FROM decisions GROUP BY 1")
def _(spark, d):
    return P.number_shape_profile(A.decisions(spark, d))


@_query("file_names", f"WITH {_DECISIONS} SELECT id, split_part(pdf_url, '/', -1) AS file_name FROM decisions")
def _(spark, d):
    return A.decisions(spark, d).select("id", N.file_name(F.col("pdf_url")).alias("file_name"))


_MIRROR = "https://mirror.example.org/f/"


@_query("candidate_urls", f"WITH {_DECISIONS} SELECT id, CASE WHEN contains(pdf_url, 'primary.example.org') THEN pdf_url ELSE pdf_url || ' {_MIRROR}' || split_part(pdf_url, '/', -1) END AS urls FROM decisions")
def _(spark, d):
    return A.decisions(spark, d).select("id", F.array_join(N.candidate_urls(F.col("pdf_url"), "primary.example.org", _MIRROR), " ").alias("urls"))


_FETCH_SQL = f"""WITH {_DECISIONS}, attempts AS (
  SELECT id, pdf_url AS url, 0 AS pos, doc_id % 5 > 1 AS ok, 'first ' || doc_id AS error FROM decisions
  UNION ALL SELECT id, '{_MIRROR}' || split_part(pdf_url, '/', -1), 1, doc_id % 5 = 0, 'second ' || doc_id FROM decisions WHERE NOT contains(pdf_url, 'primary.example.org')
), log AS (
  SELECT url, bool_or(ok) AS ok, max(error) AS error FROM attempts GROUP BY url
), tried AS (
  SELECT id, url, pos, log.ok, log.error FROM attempts JOIN log USING (url)
) SELECT id, min_by(url, pos) FILTER (ok) AS url, CASE WHEN count(*) FILTER (ok) = 0 THEN max_by(error, pos) END AS error FROM tried GROUP BY id"""


@_query("resolve_fetches", _FETCH_SQL)
def _(spark, d):
    m = A.decisions(spark, d).withColumn("n", F.col("id").cast("long"))
    urls = m.select("id", N.candidate_urls(F.col("pdf_url"), "primary.example.org", _MIRROR).alias("urls"))
    # A log of fetches: first URLs fail for two of five documents, mirrors succeed for one of five.
    first = m.groupBy(F.col("pdf_url").alias("url")).agg(F.max(F.col("n") % 5 > 1).alias("ok"), F.max(F.concat(F.lit("first "), "id")).alias("error"))
    second = m.where(~F.col("pdf_url").contains("primary.example.org")).groupBy(F.concat(F.lit(_MIRROR), N.file_name(F.col("pdf_url"))).alias("url")).agg(F.max(F.col("n") % 5 == 0).alias("ok"), F.max(F.concat(F.lit("second "), "id")).alias("error"))
    return P.resolve_fetches(urls, first.unionByName(second))


@_query("file_name_collisions", f"WITH {_DECISIONS}, named AS (SELECT id, split_part(pdf_url, '/', -1) AS file_name FROM decisions UNION ALL SELECT id || '-again', split_part(pdf_url, '/', -1) FROM decisions WHERE doc_id % 5 = 0) SELECT id, file_name FROM named WHERE file_name IN (SELECT file_name FROM named GROUP BY 1 HAVING count(DISTINCT id) > 1)")
def _(spark, d):
    m = A.decisions(spark, d)
    again = m.where(F.col("id").cast("long") % 5 == 0).withColumn("id", F.concat("id", F.lit("-again")))
    return P.file_name_collisions(m.unionByName(again)).select("id", "file_name")


@_query("repair_numbers", f"WITH {_DECISIONS} SELECT id, CASE WHEN number <> '' THEN number ELSE CASE WHEN doc_id % 2 = 0 THEN '' END END AS number, CASE WHEN number <> '' THEN year ELSE '' END AS year, number <> '' AND doc_id % 3 <> 1 AS changed FROM decisions")
def _(spark, d):
    m = A.decisions(spark, d).withColumn("n", F.col("id").cast("long"))
    lost = F.when(F.col("n") % 2 == 0, F.lit(""))
    keep = (F.col("n") % 3 == 1) & (F.col("number") != "")
    broken = m.withColumns({"number": F.when(keep, F.col("number")).otherwise(lost), "year": F.when(keep, F.col("year")).otherwise(F.lit(""))})
    return P.repair_numbers(broken).select("id", "number", "year", "changed")


# --- tables -----------------------------------------------------------------------------------------------------

_UPSERT_SQL = f"""WITH {_DECISIONS}, old AS (SELECT * FROM decisions WHERE doc_id % 10 <> 0), incoming AS (
  SELECT id, number || 'x' AS number, year, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS dtype, pdf_url FROM decisions WHERE doc_id % 5 = 0
) SELECT coalesce(o.id, i.id) AS id, CASE WHEN i.id IS NOT NULL THEN i.number ELSE o.number END AS number, CASE WHEN i.id IS NOT NULL THEN i.dtype ELSE o.dtype END AS dtype,
  coalesce(status, 'new') AS status, coalesce(text_chars, 0) AS text_chars, coalesce(n_chunks, 0) AS n_chunks FROM old o FULL JOIN incoming i ON o.id = i.id"""


@_query("upsert_decisions", _UPSERT_SQL)
def _(spark, d):
    m = A.decisions(spark, d).withColumn("n", F.col("id").cast("long"))
    come = m.where("n % 5 = 0").withColumn("number", F.concat("number", F.lit("x")))
    twice = come.withColumns({"dtype": F.lit("first"), "at": F.lit(0)}).unionByName(come.where("n % 2 = 0").withColumns({"dtype": F.lit("second"), "at": F.lit(1)}))
    out = U.upsert_decisions(m.where("n % 10 != 0").drop("n"), twice, "at")
    return out.select("id", "number", "dtype", "status", F.col("text_chars").cast("long").alias("text_chars"), "n_chunks")


_PENDING = f"WITH {_DECISIONS} SELECT id, number, year, status FROM decisions WHERE status IN ('new', 'error') AND {_INT.format('year')} >= 2020 ORDER BY {_INT.format('year')} DESC, {_INT.format('number')} DESC, id"


@_query("select_pending", _PENDING)
def _(spark, d):
    return U.select_pending(A.decisions(spark, d), min_year=2020).select("id", "number", "year", "status")


@_query("next_batch", _PENDING + " LIMIT 25")
def _(spark, d):
    return U.select_pending(A.decisions(spark, d), min_year=2020, limit=25).select("id", "number", "year", "status")


@_query("recent_pending", f"WITH {_DECISIONS} SELECT id FROM decisions WHERE status IN ('new', 'error') AND {_INT.format('year')} >= 2024")
def _(spark, d):
    return U.select_pending(A.decisions(spark, d), min_year=U.recent_min_year(dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc))).select("id")


@_query("collapse_whitespace", f"SELECT doc_id, {_FLAT} AS flat FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.collapse_whitespace(F.col("text")).alias("flat"))


@_query("chunk_text", f"WITH {_WINDOWS} SELECT decision_id, pos, text FROM windows")
def _(spark, d):
    return K.chunk_pages(A.pages(spark, d)).select("decision_id", F.col("pos").cast("long").alias("pos"), "text")


def _built(spark, d):
    return K.number_chunks(K.drop_short_chunks(K.chunk_pages(A.pages(spark, d))))


@_query("number_chunks", f"WITH {_WINDOWS} SELECT decision_id, idx, text FROM numbered")
def _(spark, d):
    return _built(spark, d).select("decision_id", F.col("idx").cast("long").alias("idx"), "text")


_CLASSES = f"""classed AS (
  SELECT CAST(doc_id AS VARCHAR) AS decision_id, CASE WHEN length(text) >= 200 THEN 'embedded' ELSE 'no_text' END AS status, length(text) AS text_chars,
    CASE WHEN length(text) >= 200 THEN coalesce(n, 0) ELSE 0 END AS n_chunks
  FROM documents LEFT JOIN (SELECT decision_id, count(*) AS n FROM numbered GROUP BY 1) c ON c.decision_id = CAST(doc_id AS VARCHAR)
)"""


@_query("classify_documents", f"WITH {_WINDOWS}, {_CLASSES} SELECT * FROM classed")
def _(spark, d):
    return U.classify_documents(A.pages(spark, d), _built(spark, d))


_OUTCOME_SQL = f"""WITH {_DECISIONS}, {_WINDOWS}, {_CLASSES}, o AS (
  SELECT decision_id, CASE WHEN CAST(decision_id AS BIGINT) % 8 = 3 THEN 'error' ELSE status END AS status, text_chars, n_chunks FROM classed WHERE CAST(decision_id AS BIGINT) % 2 = 1
) SELECT id, coalesce(o.status, d.status) AS status, CASE WHEN o.status <> 'error' THEN o.text_chars ELSE d.text_chars END AS text_chars,
  CASE WHEN o.status <> 'error' THEN o.n_chunks ELSE d.n_chunks END AS n_chunks, coalesce(o.status <> 'error', false) AS done FROM decisions d LEFT JOIN o ON o.decision_id = d.id"""


@_query("apply_outcomes", _OUTCOME_SQL)
def _(spark, d):
    made = U.classify_documents(A.pages(spark, d), _built(spark, d)).withColumn("n", F.col("decision_id").cast("long")).where("n % 2 = 1")
    outcomes = made.select(F.col("decision_id").alias("id"), F.when(F.col("n") % 8 == 3, "error").otherwise(F.col("status")).alias("status"), "text_chars", "n_chunks")
    out = U.apply_outcomes(A.decisions(spark, d), outcomes)
    return out.select("id", "status", F.col("text_chars").cast("long").alias("text_chars"), "n_chunks", F.col("ingested_at").isNotNull().alias("done"))


@_query("remaining_work", f"WITH {_DECISIONS} SELECT id, status FROM decisions WHERE status NOT IN ('embedded', 'no_text')")
def _(spark, d):
    return U.remaining_work(A.decisions(spark, d)).select("id", "status")


@_query("corpus_stats", f"WITH {_DECISIONS}, {_CHUNKS}, each AS (SELECT status, coalesce(n, 0) AS n FROM decisions LEFT JOIN (SELECT decision_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.decision_id = id) SELECT status, count(*) AS n_decisions, CAST(sum(n) AS BIGINT) AS n_chunks FROM each GROUP BY ROLLUP (status)")
def _(spark, d):
    return U.corpus_stats(A.decisions(spark, d), A.chunks(spark, d))


@_query("replace_chunks", f"WITH {_CHUNKS} SELECT decision_id, idx, text || CASE WHEN CAST(decision_id AS BIGINT) % 2 = 0 THEN ' (old)' ELSE '' END AS text FROM chunks WHERE CAST(decision_id AS BIGINT) % 3 <> 0 UNION ALL SELECT decision_id, idx, text FROM numbered WHERE CAST(decision_id AS BIGINT) % 3 = 0")
def _(spark, d):
    third = F.col("decision_id").cast("long") % 3 == 0
    new = _built(spark, d).where(third).select("decision_id", "idx", "page", "text", F.lit(None).cast("array<float>").alias("vec"))
    ids = A.decisions(spark, d).select(F.col("id").alias("decision_id")).where(third)
    ids = ids.union(A.chunks(spark, d).select("decision_id").where(third)).distinct()
    old = A.chunks(spark, d).withColumn("text", F.concat("text", F.when(F.col("decision_id").cast("long") % 2 == 0, " (old)").otherwise("")))
    return U.replace_chunks(old, new, ids).select("decision_id", F.col("idx").cast("long").alias("idx"), "text")


# --- text functions ---------------------------------------------------------------------------------------------

@_query("norm_text", f"SELECT doc_id, strip_accents(text) AS plain, {_NORM.format('text')} AS norm FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.strip_accents(F.col("text")).alias("plain"), X.norm_text(F.col("text")).alias("norm"))


@_query("search_tokens", f"SELECT doc_id, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS tokens FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.search_tokens(F.col("text"))), " ").alias("tokens"))


@_query("query_numbers", f"WITH {_DECISIONS}, {_QUERIES} SELECT query_id, array_to_string(list_sort({_NUMBERS.format('text')}), ' ') AS numbers FROM asked")
def _(spark, d):
    return A.queries(spark, d).select("query_id", F.array_join(F.array_sort(X.query_numbers(F.col("text"))), " ").alias("numbers"))


@_query("decision_refs", f"WITH {_DECISIONS}, {_QUERIES} SELECT DISTINCT query_id, {_FOLD.format('r[1]')} AS number, r[2] AS year FROM (SELECT query_id, unnest({_REFS.format('text')}) AS r FROM asked)")
def _(spark, d):
    return A.queries(spark, d).select("query_id", F.explode(X.decision_refs(F.col("text"))).alias("r")).select("query_id", "r.number", "r.year")


@_query("snippets", f"WITH {_DECISIONS} SELECT d.doc_id, {_SNIPPET.format('text')} AS snippet, {_TITLE} AS title FROM decisions d JOIN documents USING (doc_id)")
def _(spark, d):
    m = A.decisions(spark, d).withColumn("doc_id", F.col("id").cast("long"))
    return m.join(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", X.snippet(F.col("text")).alias("snippet"), X.decision_title(F.col("number"), F.col("year"), F.col("dtype")).alias("title"))


# --- vectors ----------------------------------------------------------------------------------------------------

_MICRO = "array_to_string(list_transform({0}, lambda x: CAST(floor(x * 1000000.0 + 0.5) AS BIGINT)), ' ')"


def _micro(c):
    """A vector's components in millionths, as text."""
    return F.array_join(F.transform(c, lambda x: F.floor(x.cast("double") * 1000000.0 + 0.5).cast("string")), " ")


@_query("l2_normalize", "SELECT vec_id, " + _MICRO.format("list_transform(v, lambda x: x / n)") + " AS micro FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def _(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", _micro(V.l2_normalize(F.col("embedding"))).alias("micro"))


@_query("cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = A.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 9).alias("sim"))


@_query("vector_codec", "SELECT vec_id, len(embedding) * 4 AS n_bytes, " + _MICRO.format("embedding::DOUBLE[]") + " AS micro FROM embeddings")
def _(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", V.encode_vector(F.col("embedding")).alias("b"))
    return e.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), _micro(V.decode_vector(F.col("b"))).alias("micro"))


@_query("vector_agreement", "SELECT round(avg(s), 9) AS mean_cosine, round(min(s), 9) AS min_cosine FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def _(spark, d):
    e = A.table(spark, d, "embeddings")
    out = E.vector_agreement(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("vec")))
    return out.select(F.round("mean_cosine", 9).alias("mean_cosine"), F.round("min_cosine", 9).alias("min_cosine"))


_OVERLAP_SQL = f"""{_SEARCH}, {_pooled(200)}, {_best(8)}, plain AS (
  SELECT query_id, decision_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, decision_id) AS rank
  FROM (SELECT query_id, decision_id, max(sim) AS sim FROM pooled GROUP BY ALL) QUALIFY rank <= 8
) SELECT round(avg(share), 9) AS overlap FROM (SELECT query_id, count(p.rank) / 8.0 AS share FROM best b LEFT JOIN plain p USING (query_id, decision_id) GROUP BY query_id)"""


@_query("topk_overlap", _OVERLAP_SQL)
def _(spark, d):
    q, c, m = _search_inputs(spark, d)
    plain = R.vector_topn(q, c, 200).groupBy("query_id", "decision_id").agg(F.max("sim").alias("sim"))
    plain = plain.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "decision_id")))
    return E.topk_overlap(R.best_per_decision(R.rank_chunks(q, c, m, 200), 8), plain).select(F.round("overlap", 9).alias("overlap"))


@_query("embed_column")
def _(spark, d):
    out = E.embed_column(_built(spark, d), "text")
    return out.select("decision_id", "idx", F.size("vec").alias("width"), F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("length"))


# --- prompts and chats ------------------------------------------------------------------------------------------

_WHO = f"CASE WHEN role = 'user' THEN '{G.USER}' ELSE '{G.ASSISTANT}' END"


def _history(n: int, chars: int) -> str:
    return f"list({_WHO} || ': ' || substring(coalesce(content, ''), 1, {chars})) OVER (PARTITION BY chat_id ORDER BY id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@_query("history_window", f"WITH {_CHATS} SELECT chat_id, id, coalesce(array_to_string({_history(6, 500)}, chr(10)), '') AS history FROM messages")
def _(spark, d):
    return G.history_window(A.messages(spark, d))


_FOLLOW_SQL = f"""WITH {_CHATS}, h AS (SELECT chat_id, id, content, {_history(4, 300)} AS lines FROM messages)
SELECT chat_id, id, CASE WHEN coalesce(len(lines), 0) = 0 THEN content ELSE '{G.REWRITE}' || chr(10) || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '{G.USER}: ' || coalesce(content, '') END AS prompt FROM h"""


@_query("followup_prompt", _FOLLOW_SQL)
def _(spark, d):
    return G.followup_prompt(A.messages(spark, d))


_EFFECTIVE_SQL = """SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn > 0 THEN trim(split_part(trim(CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || text || chr(10) || 'second' END, ' ' || chr(10)), chr(10), 1), ' ') END, ''), text) AS query FROM conversations"""


@_query("effective_query", _EFFECTIVE_SQL)
def _(spark, d):
    t = F.col("turn") % 3
    rewritten = F.when(t == 0, F.lit(None).cast("string")).when(t == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\nsecond")))
    return A.table(spark, d, "conversations").select("conv_id", "turn", G.effective_query(F.col("text"), F.col("turn") > 0, rewritten).alias("query"))


_HITS = f"""{_SEARCH}, {_pooled(250)}, {_best(10)}, hits AS (
  SELECT query_id, rank, number, year, dtype, pdf_url, chunks.text AS text, {_TITLE} AS title
  FROM best JOIN chunks USING (decision_id, idx) JOIN decisions ON decisions.id = decision_id
), contexts AS (
  SELECT query_id, coalesce(string_agg('[' || number || '/' || year || '] (' || dtype || ')' || chr(10) || substring(h.text, 1, 1200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '{G.NO_CONTEXT}') AS context
  FROM asked LEFT JOIN hits h USING (query_id) GROUP BY query_id
)"""


def _hits(spark, d):
    return S.top_chunks(*_search_inputs(spark, d))


@_query("context_blocks", f"{_HITS} SELECT query_id, context FROM contexts")
def _(spark, d):
    return G.context_blocks(_search_inputs(spark, d)[0], _hits(spark, d))


_PROMPT_SQL = f"""{_HITS}, {_CHATS}, h AS (
  SELECT chat_id AS query_id, array_to_string(lines, chr(10)) AS history FROM (SELECT *, {_history(6, 500)} AS lines FROM messages) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) = 1
) SELECT query_id, '{G.SYSTEM}' || chr(10) || chr(10) || CASE WHEN coalesce(history, '') <> '' THEN '{G.HISTORY_HEAD}' || chr(10) || history || chr(10) || chr(10) ELSE '' END
  || '{G.EXCERPTS_HEAD}' || chr(10) || context || chr(10) || chr(10) || '{G.QUESTION_HEAD}' || chr(10) || asked.text || chr(10) || chr(10) || '{G.ANSWER_HEAD}' AS prompt
FROM asked JOIN contexts USING (query_id) LEFT JOIN h USING (query_id)"""


@_query("grounded_prompts", _PROMPT_SQL)
def _(spark, d):
    m = A.messages(spark, d)
    last = m.groupBy("chat_id").agg(F.max("id").alias("id"))
    history = G.history_window(m).join(last, ["chat_id", "id"]).select(F.col("chat_id").alias("query_id"), "history")
    return G.grounded_prompts(_search_inputs(spark, d)[0].select("query_id", F.col("text").alias("question")), _hits(spark, d), history)


_SOURCES_SQL = f"""{_HITS}, firsts AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, number, year ORDER BY rank) = 1
) SELECT query_id, count(*) AS n_sources, string_agg('[' || number || '/' || year || '](' || pdf_url || ')', '  ·  ' ORDER BY rank) AS line FROM firsts GROUP BY query_id"""


@_query("sources_and_citations", _SOURCES_SQL)
def _(spark, d):
    return G.dedupe_sources(_hits(spark, d)).select("query_id", F.size("sources").cast("long").alias("n_sources"), G.citation_line(F.col("sources")).alias("line"))


_LIST_SQL = f"WITH {_CHATS} SELECT owner AS viewer, id, title, updated_s, coalesce(n, 0) AS n_messages FROM chats LEFT JOIN (SELECT chat_id, count(*) AS n FROM messages GROUP BY 1) m ON m.chat_id = id WHERE owner IS NOT NULL"


@_query("list_chats", _LIST_SQL)
def _(spark, d):
    chats = A.chats(spark, d)
    return C.list_chats(chats, A.messages(spark, d), chats.select("owner").distinct()).select("viewer", "id", "title", F.unix_timestamp("updated_at").alias("updated_s"), "n_messages")


def _requests(spark, d):
    return A.chats(spark, d).select(F.col("id").alias("ask_id"), F.when(F.col("id") % 4 == 0, F.col("id") + 100_000).otherwise(F.col("id")).alias("chat_id"), F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("owner"))


_ASKS = "asks AS (SELECT id AS ask_id, CASE WHEN id % 4 = 0 THEN id + 100000 ELSE id END AS chat_id, 'u' || id % 3 AS owner FROM chats), mine AS (SELECT a.* FROM asks a JOIN chats c ON a.chat_id = c.id AND a.owner = c.owner)"


@_query("owned", f"WITH {_CHATS}, {_ASKS} SELECT ask_id, chat_id, owner FROM mine")
def _(spark, d):
    return C.owned(_requests(spark, d), A.chats(spark, d))


@_query("route_asks", f"WITH {_CHATS}, {_ASKS} SELECT ask_id, m.ask_id IS NULL AS is_new, CASE WHEN m.ask_id IS NULL THEN 'new-' || a.ask_id ELSE CAST(a.chat_id AS VARCHAR) END AS target FROM asks a LEFT JOIN mine m USING (ask_id)")
def _(spark, d):
    return C.route_asks(_requests(spark, d), A.chats(spark, d)).select("ask_id", "is_new", "target")


_TRANSCRIPT_SQL = f"""WITH {_CHATS}, {_ASKS}
SELECT m.chat_id, m.id, role, content, CASE WHEN role <> 'assistant' THEN NULL WHEN (m.id % 1000) % 2 = 0 THEN '[]' ELSE '[{{"number":"' || chat_id || '","year":"2024"}}]' END AS sources
FROM messages m WHERE chat_id IN (SELECT chat_id FROM mine)"""


@_query("chat_transcript", _TRANSCRIPT_SQL)
def _(spark, d):
    out = C.chat_transcript(A.messages(spark, d), _requests(spark, d), A.chats(spark, d))
    return out.select("chat_id", "id", "role", "content", F.to_json("sources").alias("sources"))


_APPEND_SQL = f"""WITH {_CHATS}, added AS (SELECT id + 500 AS id, chat_id, content, at_s + 7 AS at_s FROM messages WHERE chat_id % 2 = 0 AND role = 'user'), latest AS (SELECT chat_id, max(at_s) AS at_s FROM added GROUP BY 1)
SELECT id, coalesce(at_s, updated_s) AS updated_s, n AS n_messages FROM chats LEFT JOIN latest ON latest.chat_id = id
JOIN (SELECT chat_id, count(*) AS n FROM (SELECT chat_id FROM messages UNION ALL SELECT chat_id FROM added) GROUP BY 1) c ON c.chat_id = id"""


@_query("append_messages", _APPEND_SQL)
def _(spark, d):
    m = A.messages(spark, d)
    new = m.where("chat_id % 2 = 0 AND role = 'user'").withColumns({"id": F.col("id") + 500, "created_at": F.col("created_at") + F.expr("interval 7 seconds")})
    chats, everything = C.append_messages(A.chats(spark, d), m, new)
    return chats.select("id", F.unix_timestamp("updated_at").alias("updated_s")).join(C.message_counts(everything).withColumnRenamed("chat_id", "id"), "id")


@_query("chat_titles", f"WITH {_CHATS} SELECT chat_id, substring(min_by(coalesce(content, ''), id), 1, 60) AS title FROM messages WHERE role = 'user' GROUP BY 1")
def _(spark, d):
    return C.chat_titles(A.messages(spark, d))


@_query("message_counts", f"WITH {_CHATS} SELECT chat_id, count(*) AS n_messages FROM messages GROUP BY 1")
def _(spark, d):
    return C.message_counts(A.messages(spark, d))


_DELETE_SQL = f"""WITH {_CHATS}, {_ASKS}, gone AS (SELECT DISTINCT chat_id FROM mine)
SELECT a.ask_id AS id, m.ask_id IS NOT NULL AS ok, EXISTS (SELECT 1 FROM chats c WHERE c.id = a.ask_id AND c.id NOT IN (SELECT chat_id FROM gone)) AS stays,
  (SELECT count(*) FROM messages x WHERE x.chat_id = a.ask_id AND x.chat_id NOT IN (SELECT chat_id FROM gone)) AS n_left FROM asks a LEFT JOIN mine m USING (ask_id)"""


@_query("delete_chats", _DELETE_SQL)
def _(spark, d):
    chats, messages, told = C.delete_chats(A.chats(spark, d), A.messages(spark, d), _requests(spark, d))
    left = C.message_counts(messages).select(F.col("chat_id").alias("id"), F.col("n_messages").alias("n_left"))
    out = told.select(F.col("ask_id").alias("id"), "ok").join(chats.select("id", F.lit(True).alias("stays")), "id", "left").join(left, "id", "left")
    return out.select("id", "ok", F.coalesce("stays", F.lit(False)).alias("stays"), F.coalesce("n_left", F.lit(0)).alias("n_left"))


@_query("with_owner", f"WITH {_CHATS} SELECT id, title, CASE WHEN id % 2 = 0 THEN owner END AS owner FROM chats")
def _(spark, d):
    chats = A.chats(spark, d)
    return C.with_owner(chats.where("id % 2 = 0")).unionByName(C.with_owner(chats.where("id % 2 != 0").drop("owner"))).select("id", "title", "owner")


# --- events -----------------------------------------------------------------------------------------------------

@_query("assemble_turns", "SELECT user_id AS turn_id, string_agg(event_type, '' ORDER BY event_id) AS text, max_by(props, event_id) FILTER (event_type = 'purchase' AND props NOT IN ('', '[]')) AS sources FROM events GROUP BY user_id")
def _(spark, d):
    return H.assemble_turns(A.token_events(spark, d))


_DEBOUNCE_SQL = """WITH marked AS (
  SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), runs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked)
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS settled_at, trim(max_by(event_type, (ts, event_id))) AS text FROM runs GROUP BY user_id, run HAVING length(trim(max_by(event_type, (ts, event_id)))) > 1"""


@_query("debounce_queries", _DEBOUNCE_SQL)
def _(spark, d):
    return H.debounce_queries(A.query_log(spark, d), "6 hours").select("user_id", F.date_format("settled_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("settled_at"), "text")


# --- feeds, pages and token lines made from the given tables ----------------------------------------------------

def _feed(spark, d):
    """Feed rows of the decisions; every seventh has no link."""
    link = F.when(F.col("id").cast("long") % 7 != 0, F.concat(F.lit("<a href='"), "pdf_url", F.lit("'>")))
    cells = F.array(F.col("id"), F.concat(F.lit(" "), "dtype"), F.concat(F.lit("01/01/"), "year"), link, F.lit(None).cast("string"))
    return A.decisions(spark, d).select(F.lit(9).cast("long").alias("recordsTotal"), cells.alias("cells"))


@_query("parse_feed_rows", f"WITH {_DECISIONS} SELECT id, number, year, dtype, pdf_url, '01/01/' || year AS source_date, '[' || array_to_string(list_transform([id, ' ' || dtype, '01/01/' || year, '<a href=' || chr(39) || pdf_url || chr(39) || '>', ''], lambda c: chr(34) || c || chr(34)), ',') || ']' AS raw_json FROM decisions WHERE doc_id % 7 <> 0")
def _(spark, d):
    return P.parse_feed_rows(_feed(spark, d)).select("id", "number", "year", "dtype", "pdf_url", "source_date", "raw_json")


@_query("feed_tallies", f"WITH {_DECISIONS} SELECT count(*) FILTER (doc_id % 7 <> 0) AS saved, count(*) FILTER (doc_id % 7 = 0) AS skipped, 9::BIGINT AS announced FROM decisions")
def _(spark, d):
    return P.feed_tallies(_feed(spark, d))


@_query("extract_pages", "SELECT CAST(doc_id AS VARCHAR) AS decision_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page, unnest(string_split(text, chr(10))) AS text FROM documents")
def _(spark, d):
    docs = A.pages(spark, d).select("decision_id", F.encode(F.translate("text", "\n", "\f"), "UTF-8").alias("content"))
    return extract_pages(docs).select("decision_id", F.col("page").cast("long").alias("page"), "text")


@_query("parse_token_lines", "SELECT user_id AS turn_id, event_id AS seq, event_type AS token FROM events WHERE event_id % 5 > 1")
def _(spark, d):
    n = F.col("seq") % 5
    line = F.when(n == 0, F.lit("data: [DONE]")).when(n == 1, F.lit(": wait")).otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "token", F.lit('"}}]}')))
    return H.parse_token_lines(A.token_events(spark, d).withColumn("line", line), "openai").select("turn_id", "seq", "token")


def _quoted(c):
    """A text as a JSON string."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


@_query("parse_gemini_lines", "SELECT user_id AS turn_id, event_id AS seq, event_type || props AS token FROM events WHERE event_id % 5 > 1")
def _(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), "ts", "event_type", F.col("props").alias("more"))
    body = F.concat(F.lit('data:{"candidates":[{"content":{"parts":[{"text":'), _quoted(F.col("event_type")), F.lit('},{"other":1},{"text":'), _quoted(F.col("more")), F.lit("}]}}]}"))
    n = F.col("seq") % 5
    line = F.when(n == 0, F.lit('data: {"candidates":[{"content')).when(n == 1, F.lit('data: {"candidates":[]}')).otherwise(body)
    return H.parse_token_lines(e.withColumn("line", line), "gemini").select("turn_id", "seq", "token")


_NDJSON_SQL = """WITH marked AS (SELECT *, min(CASE WHEN event_id % 7 = 3 THEN event_id END) OVER (PARTITION BY user_id) AS ends FROM events)
SELECT user_id AS turn_id, event_id AS seq, event_type AS token FROM marked WHERE event_id % 5 <> 0 AND (ends IS NULL OR event_id <= ends)"""


@_query("parse_ndjson_lines", _NDJSON_SQL)
def _(spark, d):
    """Every fifth line is broken, or has no text if it is done; a turn ends at its first done line."""
    done = F.when(F.col("seq") % 7 == 3, F.lit("true")).otherwise(F.lit("false"))
    body = F.concat(F.lit('{"message":{"content":'), F.when(F.col("seq") % 5 == 0, F.lit('""')).otherwise(_quoted(F.col("token"))), F.lit('},"done":'), done, F.lit("}"))
    line = F.when((F.col("seq") % 5 == 0) & (F.col("seq") % 7 != 3), F.lit('{"message":{"con')).otherwise(body)
    return H.parse_token_lines(A.token_events(spark, d).withColumn("line", line), "ndjson").select("turn_id", "seq", "token")


# --- sources and streams, over files that the given tables are written to ---------------------------------------

def _pages(spark, d, folder):
    """The feed landed as pages of 500 rows, a file each."""
    rows = _feed(spark, d).withColumn("page", F.floor(F.get("cells", F.lit(0)).cast("long") / 500))
    pages = rows.groupBy("page", "recordsTotal").agg(F.collect_list("cells").alias("data"))
    pages.select("recordsTotal", "data").write.option("maxRecordsPerFile", 1).json(folder)


@_query("read_feed", f"WITH {_DECISIONS} SELECT id, number, year, dtype, pdf_url, '01/01/' || year AS source_date, 9::BIGINT AS announced FROM decisions WHERE doc_id % 7 <> 0")
def _(spark, d):
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    _pages(spark, d, folder)
    return P.parse_feed_rows(read_feed(spark, folder).withColumnRenamed("recordsTotal", "announced").withColumn("recordsTotal", F.lit(0)), "announced").select("id", "number", "year", "dtype", "pdf_url", "source_date", "announced")


@_query("read_tables", f"WITH {_DECISIONS}, {_CHUNKS} SELECT d.id, d.number, d.status, c.idx, c.text, " + _MICRO.format("c.vec::DOUBLE[]") + " AS micro FROM decisions d JOIN chunks c ON c.decision_id = d.id")
def _(spark, d):
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    A.decisions(spark, d).write.parquet(f"{folder}/decisions")
    A.chunks(spark, d).write.parquet(f"{folder}/chunks")
    decisions, chunks = read_tables(spark, folder)
    return decisions.select("id", "number", "status").join(chunks.withColumnRenamed("decision_id", "id"), "id").select("id", "number", "status", F.col("idx").cast("long").alias("idx"), "text", _micro(F.col("vec")).alias("micro"))


@_query("read_documents", "SELECT doc_id, sha256(replace(text, chr(10), chr(12))) AS sha FROM documents")
def _(spark, d):
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    A.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.translate("text", "\n", "\f")).alias("value")).write.text(folder)
    lines = read_documents(spark, folder, "*.txt").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line != ''")
    return lines.select(F.substring_index("line", "|", 1).cast("long").alias("doc_id"), F.sha2(F.expr("substring(line, instr(line, '|') + 1)"), 256).alias("sha"))


_STREAM_SQL = f"""WITH {_DECISIONS} SELECT id, CASE WHEN doc_id % 7 = 0 THEN number || '-old' ELSE number END AS number, CASE WHEN doc_id % 2 = 0 THEN status ELSE 'new' END AS status
FROM decisions WHERE doc_id % 2 = 0 OR doc_id % 7 <> 0"""


@_query("stream_feed_upsert", _STREAM_SQL)
def _(spark, d):
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    known = A.decisions(spark, d).where(F.col("id").cast("long") % 2 == 0).withColumn("number", F.concat("number", F.lit("-old")))
    publish(known, root, "decisions")
    _pages(spark, d, f"{root}/landing")
    stream_feed_upsert(spark, f"{root}/landing", root, f"{root}/checkpoint").awaitTermination()
    return current(spark, root, "decisions").select("id", "number", "status")


_REFRESH_SQL = f"""WITH {_DECISIONS}, {_WINDOWS}, {_CLASSES}, table_now AS (
  SELECT *, doc_id % 2 = 1 OR doc_id % 4 = 0 AS todo, (doc_id % 2 = 1 OR doc_id % 4 = 0) AND doc_id % 5 <> 0 AS done FROM decisions WHERE doc_id % 2 = 0 OR doc_id % 7 <> 0
), stored AS (
  SELECT decision_id, idx, text FROM numbered JOIN table_now ON id = decision_id WHERE done
  UNION ALL SELECT id, 0, 'old ' || id FROM decisions WHERE doc_id % 3 = 0 AND id NOT IN (SELECT id FROM table_now WHERE done)
), counted AS (
  SELECT decision_id, count(*) AS n_stored, sha256(string_agg(text, chr(10) ORDER BY idx)) AS sha FROM stored GROUP BY 1
)
SELECT t.id, CASE WHEN done THEN c.status WHEN todo THEN 'error' ELSE t.status END AS status,
  CASE WHEN done THEN c.text_chars WHEN t.doc_id % 2 = 0 THEN t.text_chars ELSE 0 END AS text_chars,
  CASE WHEN done THEN c.n_chunks WHEN t.doc_id % 2 = 0 THEN t.n_chunks ELSE 0 END AS n_chunks,
  coalesce(n_stored, 0) AS n_stored, sha
FROM table_now t JOIN classed c ON c.decision_id = t.id LEFT JOIN counted s ON s.decision_id = t.id"""


@_query("incremental_refresh", _REFRESH_SQL)
def _(spark, d):
    """Decisions of even numbers are known, the feed brings the others; every fifth has no fetched page, every third an old chunk."""
    root, n = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}", F.col("id").cast("long")
    publish(A.decisions(spark, d).where(n % 2 == 0), root, "decisions")
    old = A.decisions(spark, d).where(n % 3 == 0).select(F.col("id").alias("decision_id"), F.lit(0).alias("idx"), F.lit(1).alias("page"), F.concat(F.lit("old "), "id").alias("text"), F.lit(None).cast("array<float>").alias("vec"))
    publish(old, root, "chunks")
    _pages(spark, d, f"{root}/landing")
    incremental_refresh(spark, f"{root}/landing", root, f"{root}/checkpoint", A.pages(spark, d).where(F.col("decision_id").cast("long") % 5 != 0))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), "\n")
    made = current(spark, root, "chunks").groupBy(F.col("decision_id").alias("id")).agg(F.count("*").alias("n_stored"), F.sha2(texts, 256).alias("sha"))
    out = current(spark, root, "decisions").join(made, "id", "left")
    return out.select("id", "status", F.col("text_chars").cast("long").alias("text_chars"), "n_chunks", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), "sha")


@_query("stream_assemble_turns", SQL["assemble_turns"])
def _(spark, d):
    """The events as a stream of files; each turn closes at its done event."""
    root = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    events = A.answer_events(spark, d)
    for done in (False, True):  # the stream reads the older files first
        events.where(F.col("done") == done).write.mode("append").parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    out = stream_assemble_turns(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")
