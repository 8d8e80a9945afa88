"""Lint of published numbers: a measured claim needs a run, and the run must fit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The claim patterns, the words and symbols of target prose, and the patterns of run ids and agent metrics.
QUALITY = r"(?U)(?i)\b(PR-?AUC|ROC-?AUC|F1|precision|recall|Brier|FPR|accuracy)\b[^.\n]{0,40}?(?<![\w-])(0\.\d+|\d{1,3}(?:\.\d+)?\s*%)"
OPERATIONAL = (
    r"(?U)(?i)\bp(?:50|95|99)\b[^.\n]{0,30}?(\d+(?:\.\d+)?)\s*(ms|s)\b",
    r"(?U)(?i)\b(?:throughput|sustained)\b[^.\n]{0,30}?(\d[\d,]*)\s*(?:tx|events|req)/s",
    r"(?U)(?i)\bcost[^.\n]{0,30}?\$(\d+(?:\.\d+)?)\s*(?:per|/)\s*investigation",
)
TARGET_WORDS = (
    r"(?U)(?i)\b(target|budget|threshold|goal|must|should|require[sd]?|aim|SLO|limit|cap|tolerance|floor|ceiling|at most|at least|under|below|above|no more than|"
    r"example|placeholder|TBD|not yet|unmeasured|hypothetical|illustrative|would be|expected|suppose)\b"
)
TARGET_SYMBOLS = r"(<|>|≤|≥|e\.g\.|i\.e\.)"
RUN_ID = r"(?i)run_id[=:\s]+([A-Za-z0-9._-]{4,})"
AGENT_METRIC = r"(?U)(?i)\b(evidence[ _-]precision|evidence[ _-]recall|unsupported[ _-]claim|investigation[ _-]accuracy|agent[ _-]disagreement|override[ _-]rate)\b"


#: Where a line ends, and what may stand before a fence.
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
FENCE = r"(?U)^[\s\x1C-\x1F]*```"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, line) of each text. A break at the very end opens no further line, and an empty text has
    none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return docs.select(key, F.posexplode(parts).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def fenced(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with is_fence, and in_code: whether an odd number of fence lines came before, within one document."""
    is_fence = F.col("line").rlike(FENCE)
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("is_fence", is_fence)
    return out.withColumn("in_code", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)


def is_target(line: Column) -> Column:
    return line.rlike(TARGET_SYMBOLS) | line.rlike(TARGET_WORDS)


def truthy(column: str, kind: T.DataType) -> Column:
    """As a condition: true, a number other than zero, a text that says neither nothing nor false nor 0, as manifests
    are read as text."""
    c = F.col(column)
    said = c if isinstance(kind, T.BooleanType) else c != 0 if isinstance(kind, T.NumericType) else ~F.lower(c.cast("string")).isin("", "false", "0")
    return F.coalesce(said, F.lit(False))


def kind(line: Column) -> Column:
    out = F.when(line.rlike(QUALITY), "quality")
    for pattern in OPERATIONAL:
        out = out.when(line.rlike(pattern), "operational")
    return out


def lint(docs: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """(key, line_no, violation): numbers without a run id, with an unknown one, quality numbers from a run below EVAL,
    agent metrics beside an external run, any claim of a dirty worktree. Code blocks and prose about targets are
    exempt; the first pattern that matches decides the kind, and only a line's first run id counts."""
    rows = fenced(lines(docs, key), key).filter("not is_fence and not in_code").filter(~is_target(F.col("line")))
    rows = rows.withColumn("kind", kind(F.col("line"))).filter(F.col("kind").isNotNull())
    rows = rows.withColumn("run_id", F.nullif(F.regexp_extract("line", RUN_ID, 1), F.lit("")))
    known = manifests.select(F.col("run_id").alias("m_id"), F.upper("track").alias("track"), F.upper("llm_tier").alias("llm_tier"), truthy("dirty_worktree", manifests.schema["dirty_worktree"].dataType).alias("dirty"))
    joined = rows.join(known, F.col("run_id") == F.col("m_id"), "left")
    found = F.col("m_id").isNotNull()
    violations = F.array_compact(F.array(
        F.when(F.col("run_id").isNull(), "no run_id"),
        F.when(F.col("run_id").isNotNull() & ~found, "unknown run_id"),
        F.when(found & (F.col("kind") == "quality") & ~F.coalesce(F.col("llm_tier") == "EVAL", F.lit(False)), "quality below EVAL"),
        F.when(found & (F.col("track") == "EXTERNAL") & F.col("line").rlike(AGENT_METRIC), "agent metric on external data"),
        F.when(found & F.col("dirty"), "dirty worktree")))
    return joined.select(key, "line_no", F.explode(violations).alias("violation"))
