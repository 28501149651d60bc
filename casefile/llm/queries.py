"""One query per operator of this subpackage, over whole tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, hard_negatives, lexical, line_dedup, near_dedup, quality, secrets, substring_dedup, token_files, toxicity, url_filter
from .shared import held_out, shared_folder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned: without the rows held out."""
    return _read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    token_files.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), metadata=("source",))
    return token_files.token_offsets(token_files.read_tokens(spark, folder))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.find_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.train(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size(F.filter("line_good", lambda p: p < 0.5)).alias("n_bad_lines"))


def _captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching in 2024 made from their id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 7919 % (366 * 86400)).alias("fetched_at"))


def _entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' hosts: every third page lists its host, every seventh the host's domain."""
    named = pages.select("page_id", url_filter.host(F.col("url")).alias("host"))
    domain = F.element_at(url_filter.patterns(F.col("host")), -1)
    which = F.when(F.col("page_id") % 3 == 0, F.col("host")).when(F.col("page_id") % 7 == 0, domain)
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("block"), F.lit("remove")), (F.col("page_id") % 4 + 1).cast("int"))
    return named.select(which.alias("pattern"), action.alias("action"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 31 % 366 * 86400).alias("listed_at"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    out = url_filter.judge_urls(_captures(pages), _entries(pages))
    return out.select("page_id", F.unix_timestamp("fetched_at").alias("fetched_s"), "blocked", "pattern", F.unix_timestamp("since").alias("since_s"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(secrets.corpus_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in secrets.KINDS], F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_ann": op5_ann,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_secrets": op13_secrets,
}

_OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS raw
  FROM documents
), filled AS (
  SELECT doc_id, line_no, trim(raw, ' ') AS line FROM lines WHERE trim(raw, ' ') <> ''
), firsts AS (
  SELECT line, length(line) AS n, row_number() OVER (ORDER BY min((doc_id, line_no))) AS place, min((doc_id, line_no)) AS origin
  FROM filled GROUP BY line
), pairs AS (
  SELECT a.line AS earlier, b.line AS line, a.n AS m, b.n AS n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n = b.n AND a.n >= 5 AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION ALL
  SELECT a.line, b.line, a.n, b.n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n = b.n AND a.n >= 5 AND right(a.line, a.n // 2) = right(b.line, a.n // 2)
  UNION ALL
  SELECT a.line, b.line, a.n, b.n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n = b.n + 1 AND b.n >= 4 AND left(a.line, b.n // 2) = left(b.line, b.n // 2)
  UNION ALL
  SELECT a.line, b.line, a.n, b.n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n = b.n + 1 AND b.n >= 4 AND right(a.line, b.n // 2) = right(b.line, b.n // 2)
  UNION ALL
  SELECT a.line, b.line, a.n, b.n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n + 1 = b.n AND a.n >= 4 AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION ALL
  SELECT a.line, b.line, a.n, b.n, b.place FROM firsts a JOIN firsts b
  ON a.place < b.place AND a.n + 1 = b.n AND a.n >= 4 AND right(a.line, a.n // 2) = right(b.line, a.n // 2)
), near AS (
  SELECT DISTINCT place FROM pairs
  WHERE len(list_filter(range(greatest(m, n)), lambda i: left(earlier, i) = left(line, i) AND
    CASE WHEN m = n THEN substring(earlier, i + 2) = substring(line, i + 2)
         WHEN m > n THEN substring(earlier, i + 2) = substring(line, i + 1)
         ELSE substring(earlier, i + 1) = substring(line, i + 2) END)) > 0
), kept AS (
  SELECT origin FROM firsts WHERE place NOT IN (SELECT place FROM near)
), result AS (
  SELECT l.doc_id, l.line_no, l.raw, trim(l.raw, ' ') = '' OR k.origin IS NOT NULL AS stays
  FROM lines l LEFT JOIN kept k ON k.origin = (l.doc_id, l.line_no)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (stays), '')) AS kept_sha256
FROM result GROUP BY doc_id
"""

_OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows SEMI JOIN repeated USING (h), (SELECT unnest(range(0, 35)) AS k)
), each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP9_SQL = r"""
WITH hosts AS (
  SELECT page_id, 1704067200 + page_id * 7919 % (366 * 86400) AS t,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1)), '') AS host
  FROM pages
), parts AS (
  SELECT *, string_split(host, '.') AS p FROM hosts
), named AS (
  SELECT page_id, t, CASE WHEN regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$|^\[') THEN [host]
    ELSE list_transform(range(1, greatest(len(p) - 1, 1) + 1), lambda i: array_to_string(p[i:], '.')) END AS ps, host FROM parts
), entries AS (
  SELECT CASE WHEN page_id % 3 = 0 THEN host WHEN page_id % 7 = 0 THEN ps[-1] END AS pattern,
    CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS weight,
    1704067200 + page_id * 31 % 366 * 86400 AS since
  FROM named
), dated AS (
  SELECT pattern, since, max(weight) AS weight FROM entries WHERE pattern IS NOT NULL GROUP BY ALL
), held AS (
  SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM dated
), judged AS (
  SELECT page_id, h.pattern, weight, since, row_number() OVER (PARTITION BY page_id ORDER BY length(h.pattern) DESC) AS n
  FROM (SELECT page_id, t, unnest(ps) AS pattern FROM named) a JOIN held h
  ON a.pattern = h.pattern AND h.weight > 0 AND h.since <= a.t AND (h.until IS NULL OR a.t < h.until)
)
SELECT a.page_id, a.t AS fetched_s, coalesce(weight = 2, false) AS blocked, j.pattern, j.since AS since_s
FROM named a LEFT JOIN judged j ON a.page_id = j.page_id AND n = 1
"""

_OP11_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

SQL: dict[str, str] = {"op11_hard_negatives": _OP11_SQL, "op12_lexical_search": _OP12_SQL, "op1_line_dedup": _OP1_SQL, "op3_substring_dedup": _OP3_SQL, "op9_url_filter": _OP9_SQL}
