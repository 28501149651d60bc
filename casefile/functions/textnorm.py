"""Text normalization, tokens, references and presentation."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What parts tokens, whole numbers, and references by number and year.
TOKEN_BREAK = "[^0-9a-zα-ω]+"
WHOLE_NUMBER = r"(?U)\b([0-9]{1,5})\b"
REFERENCE = r"(?U)\b([A-Za-zΑ-Ωα-ω]{0,2}[0-9]{1,5})\s*/\s*((?:19|20)[0-9]{2})\b"


def collapse_whitespace(c: Column) -> Column:
    """Every run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def _stripped(c: str) -> str:
    """A character's decomposition without marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


#: Fixed values of Hangul: first and last syllable, first letters of each kind, vowels and finals of a syllable.
_HANGUL = (0xAC00, 0xD7A3, 0x1100, 0x1161, 0x11A7, 21, 28)


@functools.cache
def _accents() -> tuple[str, str, dict[str, str]]:
    """Characters that leave one base, and then bare marks, which leave nothing, with their bases; characters that leave several."""
    single, marks, several = {}, [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        if _HANGUL[0] <= code <= _HANGUL[1]:
            continue
        c = chr(code)
        base = _stripped(c)
        if not base:
            marks.append(c)
        elif len(base) > 1:
            several[c] = base
        elif base != c:
            single[c] = base
    return "".join(single) + "".join(marks), "".join(single.values()), several


def _spread(c: Column, several: dict[str, str]) -> Column:
    """A text with its characters that leave several: Hangul syllables by arithmetic on code points, the others by table."""
    first, last, lead, vowel, final, vowels, finals = _HANGUL
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])

    def one(x: Column) -> Column:
        k = F.ascii(x) - first  # of a single character ascii gives the code point
        tail = F.when(k % finals == 0, F.lit("")).otherwise(char(k % finals + final))
        syllable = F.concat(char(F.floor(k / (vowels * finals)) + lead), char(F.floor(k % (vowels * finals) / finals) + vowel), tail)
        return F.when(x.between(chr(first), chr(last)), syllable).otherwise(F.coalesce(F.try_element_at(table, x), x))

    return F.array_join(F.transform(F.split(c, ""), one), "")


def strip_accents(c: Column) -> Column:
    """The text's canonical decomposition without marks: letters without their accents."""
    known, bases, several = _accents()
    some = F.when(c.rlike(f"[{''.join(several)}{chr(_HANGUL[0])}-{chr(_HANGUL[1])}]"), _spread(c, several)).otherwise(c)
    # Texts of ASCII alone, which are as long in bytes as in characters, have none.
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(some, known, bases))


def norm_text(c: Column) -> Column:
    return F.translate(F.lower(strip_accents(c)), "ς", "σ")


def search_tokens(c: Column) -> Column:
    """Distinct runs of digits and Latin or Greek letters of three characters or more, normalized."""
    return F.array_distinct(F.filter(F.split(norm_text(c), TOKEN_BREAK), lambda t: F.length(t) >= 3))


def query_numbers(c: Column) -> Column:
    """Distinct whole numbers of one to five digits."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(WHOLE_NUMBER), F.lit(1)))


def decision_refs(c: Column) -> Column:
    """Array of (number, year) for every reference NUMBER / YEAR, numbers normalized, each once."""
    from .numbers import normalize_number

    pattern = F.lit(REFERENCE)
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("number"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("year"))
    return F.array_distinct(F.transform(pairs, lambda p: F.struct(normalize_number(p["number"]).alias("number"), p["year"].alias("year"))))


def snippet(c: Column, size: int = 320) -> Column:
    """The text, or its first ``size`` characters up to the last space and an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.regexp_replace(F.substring(c, 1, size), r"(?s) [^ ]*\z", ""), F.lit("…"))).otherwise(c)


def decision_title(number: Column, year: Column, dtype: Column) -> Column:
    head = F.concat(F.lit("Απόφαση "), F.coalesce(number, F.lit("")), F.lit("/"), F.coalesce(year, F.lit("")))
    return F.concat(head, F.when(F.coalesce(dtype, F.lit("")) != "", F.concat(F.lit(" — "), dtype)).otherwise(F.lit("")))
