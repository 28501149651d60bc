"""Grounded prompts, history windows and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The headings and labels of a prompt.
USER, ASSISTANT = "Χρήστης", "Βοηθός"
NO_CONTEXT = "(καμία σχετική απόφαση)"
HISTORY_HEAD, EXCERPTS_HEAD = "=== ΠΡΟΗΓΟΥΜΕΝΗ ΣΥΝΟΜΙΛΙΑ ===", "=== ΑΠΟΣΠΑΣΜΑΤΑ ΑΠΟΦΑΣΕΩΝ ==="
QUESTION_HEAD, ANSWER_HEAD = "=== ΕΡΩΤΗΣΗ ===", "=== ΑΠΑΝΤΗΣΗ ==="
#: Default instructions; callers pass their own.
SYSTEM = "Απάντησε στα ελληνικά μόνο με βάση τα παρακάτω αποσπάσματα και ανάφερε κάθε απόφαση ως [αριθμός/έτος]."
REWRITE = "Γράψε ξανά την τελευταία ερώτηση ώστε να στέκει μόνη της, σε μία γραμμή."


def context_blocks(questions: DataFrame, hits: DataFrame, chars: int = 1200) -> DataFrame:
    """``(query_id, context)`` for every question: its hits by rank, or a placeholder."""
    block = F.struct("rank", F.concat(F.lit("["), F.coalesce("number", F.lit("")), F.lit("/"), F.coalesce("year", F.lit("")), F.lit("] ("), F.coalesce("type", F.lit("")), F.lit(")\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars)).alias("block"))
    made = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), "\n\n---\n\n").alias("context"))
    return questions.select("query_id").join(made, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def _earlier(n: int, chars: int) -> Column:
    who = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    line = F.concat(who, F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return F.collect_list(line).over(Window.partitionBy("chat_id").orderBy("id").rowsBetween(-n, -1))


def history_window(messages: DataFrame, n: int = 6, chars: int = 500) -> DataFrame:
    """``(chat_id, id, history)``: the n turns before each message, a line each, cut to ``chars``."""
    return messages.select("chat_id", "id", F.array_join(_earlier(n, chars), "\n").alias("history"))


def followup_prompt(messages: DataFrame, n: int = 4, chars: int = 300, instruction: str = REWRITE) -> DataFrame:
    """``(chat_id, id, prompt)`` per message: the question, with the instruction and the turns before it if any."""
    rows = messages.select("chat_id", "id", "content", _earlier(n, chars).alias("_h"))
    full = F.concat(F.lit(instruction + "\n\n"), F.array_join("_h", "\n"), F.lit(f"\n{USER}: "), F.coalesce("content", F.lit("")))
    return rows.select("chat_id", "id", F.when(F.size("_h") == 0, F.col("content")).otherwise(full).alias("prompt"))


def effective_query(question: Column, is_followup: Column, rewritten: Column, sharpened: Column | None = None, first_line: bool = True) -> Column:
    """What to search for: the rewrite of a follow-up, the sharpened first question if there is one, else the question."""

    def cleaned(c: Column) -> Column:
        c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return F.nullif(F.regexp_replace(F.get(F.split(c, r"\R"), F.lit(0)), r"(?U)\s+$", "") if first_line else c, F.lit(""))

    first = F.lit(None).cast("string") if sharpened is None else cleaned(sharpened)
    return F.coalesce(F.when(is_followup, cleaned(rewritten)).otherwise(first), question)


def grounded_prompts(questions: DataFrame, hits: DataFrame, history: DataFrame, system: str = SYSTEM) -> DataFrame:
    """``(query_id, prompt)`` of ``questions (query_id, question)``: system text, history if any, excerpts, question."""
    rows = questions.join(context_blocks(questions, hits), "query_id").join(history.select("query_id", "history"), "query_id", "left")
    past = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit(HISTORY_HEAD + "\n"), F.col("history"), F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.select("query_id", F.concat(F.lit(system + "\n\n"), past, F.lit(EXCERPTS_HEAD + "\n"), F.col("context"), F.lit(f"\n\n{QUESTION_HEAD}\n"), F.coalesce("question", F.lit("")), F.lit(f"\n\n{ANSWER_HEAD}")).alias("prompt"))


def dedupe_sources(hits: DataFrame) -> DataFrame:
    """``(query_id, sources)``: one source per (number, year), the first by rank, in order of rank."""
    w = Window.partitionBy("query_id", "number", "year").orderBy("rank")
    first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    source = F.struct("rank", F.struct("number", "year", "type", "pdf_url", "title").alias("s"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: x["s"]).alias("sources"))


def citation_line(sources: Column) -> Column:
    """Sources as links, set apart by dots."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("["), blank(s["number"]), F.lit("/"), blank(s["year"]), F.lit("]("), blank(s["pdf_url"]), F.lit(")"))), "  ·  ")
