"""URL filters by dated lists: every capture is judged by the list entries active when it was fetched.

Entries ``(pattern, action, listed_at)`` say from when on a domain and its subdomains are to be blocked or allowed, or
are off the list (remove). An entry holds until the next entry of its pattern: dated entries become validity intervals. A
capture meets the intervals of its host and the host's parent domains by an as-of join on equal pattern and month: those that
begin in the month, and the one that is carried into it. Only months in which a pattern has captures take part, so an interval
without an end costs no more than the captures that it judges, however far they are. The longest pattern with an active block or
allow decides. The captures of a pattern and month are dealt into ``SALTS`` parts, each with its own copy of the few intervals.

Defined results: patterns and hosts are compared in small letters; a bare top-level domain is no pattern of a host, and
an IP address has no other pattern than itself. Very long URLs are read whole.
Entries of the same pattern and time: block wins over allow, allow over remove. An interval includes its start and not
its end. URLs that are null or have no host, and null fetch times, are not blocked and have no pattern. Null patterns,
actions or times of entries are left out. Repeated captures each keep a row. Empty lists block nothing. Columns of
the captures are kept; the added ones get underscores in front where a name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh

#: The actions in rising order of precedence.
ACTIONS = ("remove", "allow", "block")
#: Parts that the captures of a pattern and month are dealt into.
SALTS = 16


def host(url: Column) -> Column:
    """The host of a URL in small letters; null without one."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def patterns(name: Column) -> Column:
    """The host and its parent domains, without the top-level domain alone; an IP address alone."""
    parts = F.split(name, r"\.")
    n = F.greatest(F.size(parts) - 1, F.lit(1))
    address = name.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$|^\[")
    return F.when(address, F.array(name)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", at: str = "listed_at") -> DataFrame:
    """``(pattern, action, valid_from, valid_to)``; ``valid_to`` is null for the last entry of a pattern."""
    weight = F.coalesce(*[F.when(F.col(action) == a, F.lit(i)) for i, a in enumerate(ACTIONS)])
    rows = entries.select(F.lower(F.col(pattern)).alias("pattern"), weight.alias("weight"), F.col(at).alias("valid_from")).where("pattern is not null and weight is not null and valid_from is not null")
    rows = rows.groupBy("pattern", "valid_from").agg(F.max("weight").alias("weight")).withColumn("month", _month(F.col("valid_from")))
    # The next entry stands in the same month, or is the first of the pattern's next month: no window holds all of a pattern.
    firsts = rows.groupBy("pattern", "month").agg(F.min("valid_from").alias("first"))
    firsts = firsts.select("pattern", "month", F.lead("first").over(Window.partitionBy("pattern").orderBy("month")).alias("later"))
    after = F.lead("valid_from").over(Window.partitionBy("pattern", "month").orderBy("valid_from"))
    rows = rows.withColumn("after", after).join(firsts, ["pattern", "month"])
    return rows.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("weight") + 1).alias("action"), "valid_from", F.coalesce("after", "later").alias("valid_to"))


def _month(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def _active(spans: DataFrame, months: DataFrame) -> DataFrame:
    """``(pattern, month, action, valid_from, valid_to)``: the intervals that hold at some time of ``months (pattern, month)``."""
    spans = spans.withColumn("month", _month(F.col("valid_from")))
    lasts = spans.groupBy("pattern", "month").agg(F.max(F.struct("valid_from", "action", "valid_to")).alias("last"))
    line = lasts.join(months.withColumn("asked", F.lit(True)), ["pattern", "month"], "full_outer")
    carried = F.last("last", True).over(Window.partitionBy("pattern").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    carried = line.withColumn("carried", carried).where("asked and carried is not null").select("pattern", "month", "carried.*")
    return spans.join(months, ["pattern", "month"], "left_semi").unionByName(carried).where("action != 'remove'")


def judge_urls(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with columns blocked (boolean), pattern (the one that decided) and since (start of its interval)."""
    added = [fresh(captures, c) for c in ("blocked", "pattern", "since")]
    h, t = fresh(captures, "h_"), fresh(captures, "t_")
    rows = captures.withColumn(h, host(F.col(url))).withColumn(t, F.col(at))
    keys = rows.select(F.col(h).alias("h"), F.col(t).alias("t")).where("h is not null and t is not null").distinct()
    asked = keys.select("h", "t", F.explode(patterns(F.col("h"))).alias("pattern"), _month(F.col("t")).alias("month"), F.pmod(F.xxhash64("h", "t"), F.lit(SALTS)).cast("int").alias("salt"))
    held = _active(intervals(entries), asked.select("pattern", "month").distinct())
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = asked.join(held, ["pattern", "month", "salt"]).where((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    best = active.groupBy("h", "t").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "valid_from")).alias("b"))
    out = rows.join(best, (rows[h] == best["h"]) & (rows[t] == best["t"]), "left")
    return out.select(*[rows[c] for c in captures.columns], F.coalesce(F.col("b.action") == "block", F.lit(False)).alias(added[0]), F.col("b.pattern").alias(added[1]), F.col("b.valid_from").alias(added[2]))
