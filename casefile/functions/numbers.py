"""Document numbers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file-name pattern, and Greek capitals that look like Latin ones with those.
FILE_PATTERN = r"(?iu)Apofasi[-_]([A-Za-zΑ-Ωα-ω]{0,2})([0-9]{1,5})[-_]([0-9]{4})\.pdf"
GREEK, LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"


def normalize_number(c: Column) -> Column:
    """Trimmed, upper case, look-alike Greek capitals as Latin ones; null: empty."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), GREEK, LATIN)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")


def number_year_from_url(c: Column) -> Column:
    """Struct (number, year) of a document's file name; both empty if it has another form."""
    url = F.coalesce(c, F.lit(""))
    part = lambda i: F.regexp_extract(url, FILE_PATTERN, i)
    return F.struct(normalize_number(F.concat(part(1), part(2))).alias("number"), part(3).alias("year"))


def raw_prefix(c: Column) -> Column:
    """The letters before the number as written in the file name; null if the name has another form."""
    return F.when(F.coalesce(c, F.lit("")).rlike(FILE_PATTERN), F.regexp_extract(c, FILE_PATTERN, 1))


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def candidate_urls(c: Column, primary_host: str, mirror_base: str) -> Column:
    """The URL, and the mirror's URL of the same file unless the URL is on the primary host already."""
    return F.when(c.contains(primary_host), F.array(c)).otherwise(F.array(c, F.concat(F.lit(mirror_base), file_name(c))))


def leading_int(c: Column) -> Column:
    """The integer that a text begins with, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
