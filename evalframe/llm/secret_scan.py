"""Secrets in versioned content, with a ledger of what has been scanned.

Every version of every path is addressed by the SHA-256 of its bytes (a
blob).  The ledger holds one row for each blob and rule version ever scanned,
with the findings; a scan looks only at pairs the ledger does not hold, and
joins the findings of a blob back to all its paths.  A changed rule gets a new
version and thereby a rescan of that rule alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm._spans import SPAN_TYPE, find_spans
from evalframe.llm._store import stored

LEDGER_SCHEMA = f"blob string, rule string, version int, findings {SPAN_TYPE}"


@dataclass(frozen=True)
class Rule:
    """``screen`` is a cheap necessary condition on the text, ``keep`` decides on a match."""

    name: str
    version: int
    pattern: str
    screen: Callable[[Column], Column] = field(default=lambda t: F.lit(True))
    keep: Callable[[Column], Column] = field(default=lambda v: F.lit(True))


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

RULES = (
    Rule("assign", 1, _ASSIGN,
         screen=lambda t: t.rlike(_ASSIGN),
         keep=lambda v: F.length(F.regexp_extract(v, _ASSIGN, 1)) >= 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", screen=lambda t: F.contains(t, F.lit("AKIA")), keep=lambda v: F.length(v) >= 20),
    # a run shorter than 24 never passes, so only whole runs of 24 and more are matched
    Rule("hex", 1, "(?<![0-9a-f])[0-9a-f]{24,}+", screen=lambda t: t.rlike("(?<![0-9a-f])[0-9a-f]{24}")),
)


def scan(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``blob`` and ``secret_spans``, rows to append to the ledger).

    Each row of ``docs`` is one version of a path.  ``ledger`` has the columns
    of LEDGER_SCHEMA (None: nothing scanned yet).  Null text is the empty
    blob.  Repeated rows and equal texts share one scan.  Columns of ``docs``
    that clash with the results are replaced.
    """
    docs = docs.drop("blob", "secret_spans").withColumn("blob", F.sha2(F.coalesce(text, F.lit("")), 256))
    body = F.coalesce(F.col(text), F.lit(""))
    todo = docs.select("blob").distinct().withColumn(
        "todo", F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    if ledger is not None:
        seen = (ledger.select("blob", "rule", "version").distinct()
                .groupBy("blob").agg(F.collect_list(F.struct("rule", "version")).alias("seen")))
        todo = (todo.join(seen, "blob", "left")
                .withColumn("todo", F.array_except("todo", F.coalesce(
                    "seen", F.expr("cast(array() as array<struct<rule:string,version:int>>)"))))
                .drop("seen"))
    todo = stored(todo.filter(F.size("todo") > 0), "secret-todo")

    # a text no rule's screen lets through cannot have a finding: only the others travel
    suspect = F.lit(False)
    for r in rules:
        suspect = suspect | r.screen(body)
    texts = docs.select("blob", body.alias("t")).filter(suspect).dropDuplicates(["blob"])
    findings = F.filter(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                 find_spans(F.col("t"), r.name, k, r.pattern, r.keep,
                            F.array_contains("todo", F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")))
                            & r.screen(F.col("t"))).alias("findings"))
        for k, r in enumerate(rules)]), lambda f: F.size(f["findings"]) > 0)
    hits = (texts.join(todo, "blob").select("blob", F.explode(findings).alias("f")).select("blob", "f.*"))
    hits = stored(hits.select("blob", "rule", "version", F.col("findings").cast(SPAN_TYPE).alias("findings")),
                  "secret-hits")
    scanned = (todo.select("blob", F.explode("todo").alias("p")).select("blob", "p.rule", "p.version")
               .join(hits, ["blob", "rule", "version"], "left")
               .withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {SPAN_TYPE})"))))

    current = hits
    if ledger is not None:
        live = " or ".join(f"(rule = '{r.name}' and version = {r.version})" for r in rules)
        current = ledger.filter(F.expr(live) & (F.size("findings") > 0)).select(hits.columns).unionByName(hits)
    per_blob = (current.dropDuplicates(["blob", "rule", "version"]).groupBy("blob")
                .agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("secret_spans")))
    out = docs.join(per_blob, "blob", "left").withColumn(
        "secret_spans", F.coalesce("secret_spans", F.expr(f"cast(array() as {SPAN_TYPE})")))
    return out, scanned


def scan_with_ledger(docs: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan`` against the ledger table (Parquet) at ``path``, to which the
    rows of this scan are appended; the first scan makes it."""
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    out, scanned = scan(docs, spark.read.schema(LEDGER_SCHEMA).parquet(path) if known else None, text, rules)
    scanned.write.mode("append").parquet(path)
    return out
