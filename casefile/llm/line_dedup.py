"""Line dedup across a corpus, exact and within one character edit, with DataFrame operations only.

A line that was seen before (in an earlier document, or earlier in its own) goes, and so does a line within one
inserted, deleted or replaced character of an earlier line, if the two are similar enough: ``1 - 1 / longer length`` is at
least ``similarity``. Near lines are found by a deletion-neighbourhood join: every line emits the hash of each variant
with one character deleted, keyed by the place, and of the line itself keyed by each place; lines that share a key are
within one edit, so a minimum per key finds the earliest one without forming pairs inside the group; the pair with the
earliest line is verified with ``levenshtein``.

Only lines that share their first or last half with another line can be within one edit (the edit touches one half
at most). The other half is narrowed in the same way, to one of 16 parts, twice. Lines that share no such part with
another leave, the others emit the variants of the part that is left: a filter that loses nothing, and whose variants
grow little with the length of a line.

Texts with such lines are cut into lines once. Keys that many lines share are joined with a salt, so that no key's lines
meet in one task.

Defined results. Order is (id, hash of the text, line number); earlier lines count even if they go themselves, so
the result does not depend on any order of work. Lines are parts between line breaks, compared without surrounding
spaces; blank lines stay. Null text stays null; an empty text stays empty; a text that loses all lines becomes empty.
Texts and lines may be very long: work grows with their length, and a task holds one text at a time. Null ids are one id
that comes first. Rows with the same id and text are one document given several times and keep the same lines. Other
columns are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh

SIMILARITY = 0.8
#: Parts that the lines of a shared key are dealt into.
SALTS = 16
#: Keys, or ids of documents with suspect lines, up to which they are broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 250_000


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the first and the last half, for pairs whose shorter line has n characters, then n - 1.

    Of two lines within one edit, the shorter one of m characters, the first or the last m // 2 characters agree."""
    both = lambda m: [F.xxhash64(F.lit("first"), m, F.substr(line, F.lit(1), F.floor(m / 2).cast("int"))), F.xxhash64(F.lit("last"), m, F.substr(line, n - F.floor(m / 2).cast("int") + 1))]
    return both(n) + both(n - 1)


def _variants(rest: Column, key: Column) -> Column:
    """Hashes of ``rest`` without each character and, keyed by the gap, of ``rest`` itself."""
    n = F.length(rest)
    at = lambda j, skip: F.xxhash64(key, F.substr(rest, F.lit(1), j), F.substr(rest, j + 1 + skip))
    gaps = F.transform(F.sequence(F.lit(0), n), lambda j: at(j, F.lit(0)))
    holes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: at(j, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(holes, gaps))


def _with_shared(rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``shared`` (one row a key, whose other columns are added)."""
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _narrowed(rows: DataFrame, blocks: int = 16) -> DataFrame:
    """Rows ``(h1, h2, at, key, base, rest)`` with each rest cut to the block that holds the edit, as far as lines agree.

    ``base`` is the length of the shorter rest of a pair under ``key``. Two rests within one edit agree in all but one of
    ``blocks`` parts (of its characters, if fewer), counted from the left before it and from the right after it; lines
    that share no such key leave."""
    parts = F.greatest(F.lit(1), F.least(F.lit(blocks), F.col("base")))
    cut_at = lambda b: F.floor(F.col("base") * b / parts).cast("int")
    n = F.length("rest")

    def part(b: Column) -> Column:
        low, right = cut_at(b), F.col("base") - cut_at(b + 1)
        key = F.xxhash64("key", b, F.substr("rest", F.lit(1), low), F.substr("rest", n - right + 1))
        return F.struct(key.alias("key"), low.alias("low"), right.alias("right"))

    each = rows.select("h1", "h2", "at", "rest", "base", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), part)).alias("p"))
    each = each.select("h1", "h2", "at", "rest", "base", "p.*")
    again = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rest = F.substr("rest", F.col("low") + 1, n - F.col("low") - F.col("right"))
    return cut(_with_shared(each, again, "key").select("h1", "h2", "at", "key", (F.col("base") - F.col("low") - F.col("right")).alias("base"), rest.alias("rest")))


def _checked(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` kept in the shared folder, and whether it has few enough rows to be broadcast."""
    df = cut(df)
    few = df.count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df, few


def near_lines(distinct: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Hashes ``(h1, h2)`` of distinct lines that have an earlier line within one edit, the longer of the two of ``least``
    characters or more."""
    keys = distinct.select("h1", "h2", "at", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key is not null")
    shared, few = _checked(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    at = F.col("at")
    suspects = cut(keys.join(shared, "key") if few else _with_shared(keys, shared, "key"))
    wanted = suspects.select("h1", "h2", at["id"].alias("sid"), at["k"].alias("sk"), at["line"].alias("sline")).distinct()
    held, _ = _checked(wanted.select("sid", "sk").distinct())
    same = F.col("id").eqNullSafe(F.col("sid")) & (F.col("k") == F.col("sk"))
    texts = rows.join(held, same, "left_semi").dropDuplicates(["id", "k"])
    lines = texts.select("id", "k", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    lines = lines.join(wanted, same & (F.col("line_no") == F.col("sline"))).select("h1", "h2", F.trim("raw").alias("line"))
    lines = cut(lines)
    text = suspects.join(lines, ["h1", "h2"]).select("h1", "h2", "at", "key", "line")
    n, key = F.length("line"), F.col("key")
    own = _half_keys(F.col("line"), n)
    half = lambda m: F.floor(m / 2).cast("int")
    base = F.when(key.isin(own[0], own[1]), n).otherwise(n - 1)
    rest = F.when(key.isin(own[0], own[2]), F.substr("line", half(F.col("base")) + 1)).otherwise(F.substr("line", F.lit(1), n - half(F.col("base"))))
    small = text.withColumn("base", base).select("h1", "h2", "at", "key", (F.col("base") - half(F.col("base"))).alias("base"), rest.alias("rest"))
    small = _narrowed(_narrowed(small))
    variants = small.select("h1", "h2", "at", F.explode(_variants(F.col("rest"), F.col("key"))).alias("variant"))
    first = variants.groupBy("variant").agg(F.min(F.struct("at", "h1", "h2")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = _with_shared(variants, first, "variant").where("at > first.at").select("h1", "h2", F.col("first.h1").alias("e1"), F.col("first.h2").alias("e2")).distinct()
    earlier = lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("earlier"))
    close = pairs.join(lines, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(SALTS)).cast("int"))
    close = close.join(earlier.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["e1", "e2", "salt"])
    close = close.where(F.greatest(F.length("line"), F.length("earlier")) >= least)
    return cut(close.where(F.levenshtein("line", "earlier", 1).between(0, 1)).select("h1", "h2").distinct())


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and columns n_lines and n_removed added
    (with underscores in front where the name is taken)."""
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    others = [c for c in docs.columns if c not in (id, text)]
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    plain = rows.select("id", "k", "text")
    line = F.col("line")
    lines = plain.select("id", "k", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).select("id", "k", "line_no", F.trim("raw").alias("line")).where("line != ''")
    # Lines of n characters with one edit are similar enough from this length of the longer one on.
    n, least = F.length(line), math.ceil(1 / (1 - similarity) - 1e-9)
    lines = lines.select(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), F.struct("id", "k", F.col("line_no").alias("line")).alias("at"), *[F.when(n >= (least - 1 if i < 2 else least), key).alias(f"k{i}") for i, key in enumerate(_half_keys(line, n))])
    distinct = cut(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("k0", "k1", "k2", "k3")]))
    kept = distinct.join(near_lines(distinct, plain, least), ["h1", "h2"], "left_anti")
    kept = kept.groupBy(F.col("at.id").alias("kid"), F.col("at.k").alias("kk")).agg(F.collect_list("at.line").alias("kept"))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("k") == F.col("kk")), "left")
    parts = F.split("text", "\n", -1)
    out = out.withColumn("parts", parts).withColumn("blank", F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.trim(F.get("parts", i)) == ""))
    out = out.withColumn("stay", F.array_sort(F.concat("blank", F.coalesce("kept", F.array().cast("array<int>")))))
    new = F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n")
    named = {id: F.col("id"), text: new} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return out.select(*[named[c].alias(c) for c in docs.columns], F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size("parts") - F.size("stay"), F.lit(0)).cast("long").alias(n_removed))
