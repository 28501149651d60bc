"""Secret scans by patterns and by character Markov models.

Three patterns name secrets by their form. Beside them, runs of letters, digits and signs of ``LEAST`` characters or more are
read by two Markov models of characters, one of random strings and one of ordinary identifiers and words: the sum over the
run of the logarithm of the ratio of both models' transition probabilities is its log-likelihood ratio, and runs of at least
``threshold`` are reported too. Both models are trained from labelled samples ``(text, label)``, label 1 for random strings:
transitions are counted by an aggregation, smoothed, and become one table of ``CODES ** 2`` numbers, whatever was learned
from, that the scan looks up by the codes of neighbouring characters.

Everything is made of DataFrame functions. Spans count code points, the end not included; they follow from the lengths of the
matches of a pattern and of the pieces between them.

Defined results: matches of a kind are the leftmost that do not overlap, found first and dropped afterwards if they are too short; a
run that overlaps a span of a pattern adds nothing; null texts are empty, empty texts have no spans; long texts are read whole;
every row gives a row, repeated rows and null ids too; samples with a null text or label are left out, and without samples
of both labels no run is reported; an empty table gives no rows; other columns of the documents are kept, the added ones get
underscores in front where a name is taken.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Kinds in order, their patterns, the group that must be long enough, and its least length.
KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Signs of which every match of a kind has one.
SIGNS = {"assign": (":=",), "access": (("AKIA",),)}
#: Least characters of a run that the models read; codes of characters (ASCII).
LEAST, CODES = 20, 128
#: What a run is made of.
_RUN = "[A-Za-z0-9+/_=-]"


def _matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """``array<struct<kind, start, end, value>>`` of the matches whose ``group`` has ``least`` characters.

    Most texts have none: those without a sign that every match has, or without a match, are not cut into pieces."""
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    each = F.arrays_zip(pieces.alias("piece"), whole.alias("match"), value.alias("value"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def place(acc: Column, x: Column) -> Column:
        """``acc``: where the piece begins, and the matches before it."""
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("found")), place, lambda acc: acc["found"])
    some = text.rlike(pattern)
    for sign in SIGNS.get(kind, ()):
        some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in sign]) & some
    return F.when(some, found).otherwise(none)


def pattern_spans(text: Column) -> Column:
    """Spans of the three kinds, by start, then kind as listed."""
    # A long run of hexadecimal digits is found as such: shorter ones, which most words have, are no matches then.
    found = F.concat(*[_matches(text, kind, pattern.replace("f]+", f"f]{{{least},}}") if kind == "hex" else pattern, group, least) for kind, pattern, group, least in KINDS])
    rank = {kind: i for i, (kind, *_) in enumerate(KINDS)}
    order = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in rank.items()])
    compare = lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(order(a) - order(b))).cast("int")
    return F.array_sort(found, compare)


def train(samples: DataFrame, text: str = "text", label: str = "label", smoothing: float = 0.05) -> Column:
    """The table of log-likelihood ratios of two neighbouring characters, from ``samples (text, label)``, as an array column.

    Counts are smoothed towards the alphabet of runs, with ``smoothing`` of a count for each transition."""
    rows = samples.select(F.col(text).alias("s"), F.col(label).cast("int").alias("label")).where("s is not null and label in (0, 1) and length(s) > 1")
    pairs = rows.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.struct(F.ascii(F.substring("s", i, F.lit(1))).alias("a"), F.ascii(F.substring("s", i + 1, F.lit(1))).alias("b")))).alias("p"))
    counts = pairs.groupBy("label", "p.a", "p.b").count().where(f"a < {CODES} and b < {CODES}").collect()  # 2 CODES ** 2 rows at most
    held: list[dict] = [{}, {}]
    for r in counts:
        held[r["label"]][r["a"], r["b"]] = r["count"]
    if not all(held):
        return F.expr(f"array_repeat(-1e9D, {CODES * CODES})")
    total = [[smoothing * 66] * CODES, [smoothing * 66] * CODES]  # 66 characters can stand in a run
    for at, row in zip(total, held, strict=True):
        for (a, _), n in row.items():
            at[a] += n
    log = lambda k, a, b: math.log((held[k].get((a, b), 0) + smoothing) / total[k][a])
    table = ",".join(f"{log(1, a, b) - log(0, a, b):.9g}" for a in range(CODES) for b in range(CODES))
    return F.expr(f"cast(split('{table}', ',') as array<double>)")


def likelihood_ratio(run: Column, table: Column) -> Column:
    """The log-likelihood ratio of a run of ASCII characters: random string against ordinary identifier."""
    code = lambda i: F.ascii(F.substring(run, i, F.lit(1)))
    start = F.struct(F.lit(0.0).alias("sum"), code(F.lit(1)).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["sum"] + F.get(table, acc["last"] * CODES + code(i))).alias("sum"), code(i).alias("last"))

    return F.when(F.length(run) > 1, F.aggregate(F.sequence(F.lit(2), F.length(run)), start, step, lambda acc: acc["sum"])).otherwise(F.lit(0.0))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, table: Column, text: str = "text", threshold: float = 10.0, least: int = LEAST) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``(kind, start, end, value)``: those of the patterns, and all.

    ``table`` comes from ``train``; what the models add has the kind ``random`` and stands behind other spans of its start."""
    base, spans = fresh(docs, "base"), fresh(docs, "spans")
    t, runs = fresh(docs, "text_"), fresh(docs, "runs_")
    rows = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn(base, pattern_spans(F.col(t))).withColumn(runs, _matches(F.col(t), "random", f"{_RUN}{{{least},}}"))
    free = lambda r: ~F.exists(base, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    added = F.filter(runs, lambda r: free(r) & (likelihood_ratio(r["value"], table) >= threshold))
    both = F.concat(base, added)
    # Base spans are in order and no added span overlaps one, so starts decide.
    ordered = F.when(F.size(added) == 0, F.col(base)).otherwise(F.array_sort(both, lambda a, b: F.sign(a["start"] - b["start"]).cast("int")))
    return rows.withColumn(spans, ordered).drop(t, runs)


def corpus_samples(docs: DataFrame, text: str = "text", id: str = "doc_id", sample_docs: int = 20_000) -> DataFrame:
    """Labelled samples ``(text, label)`` from ``sample_docs`` documents, those of the smallest hash of their id.

    Random: what the patterns found there (of assignments the value), as it is, in capitals, and its digest in base 64, so
    that no alphabet decides. Ordinary: each different run of six characters or more outside such spans that has no digit."""
    named = docs.select(F.xxhash64(id).alias("h"), F.col(text).cast("string").alias("t")).where("t is not null")
    # explode_outer, as explode would have the patterns read once more, by a filter on the arrays' sizes, in all documents.
    # Hashes alone are ordered; of a longer table the bound on them picks the documents.
    last = named.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    some = named.where(F.col("h") <= (last if last is not None else 0))
    spans = some.select("t", pattern_spans(F.col("t")).alias("base"))
    value = spans.select(F.explode_outer("base").alias("s")).select(F.col("s.value").alias("v")).where("length(v) >= 16").distinct()
    digest = F.translate(F.base64(F.unhex(F.sha2("v", 256))), "=", "")
    random = value.select(F.explode(F.array("v", F.upper("v"), digest)).alias("text"), F.lit(1).alias("label"))
    words = some.select(F.explode_outer(F.regexp_extract_all("t", F.lit("[A-Za-z+/_=-]{6,}"), F.lit(0))).alias("text")).where("text is not null").distinct().withColumn("label", F.lit(0))
    return random.unionByName(words)
