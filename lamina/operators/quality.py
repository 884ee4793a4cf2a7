"""Quality rules as data, quarantine, gates and rates."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class QualityGateError(RuntimeError):
    """A fatal rule was breached or counts did not reconcile."""


def quarantine(df: DataFrame, ok: Column | str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that do not (a null verdict fails) with ``_dq_reason``. Both are lazy."""
    verdict = F.coalesce(F.expr(ok) if isinstance(ok, str) else ok, F.lit(False))
    marked = df.withColumn("_ok", verdict)
    return marked.filter("_ok").drop("_ok"), marked.filter("NOT _ok").drop("_ok").withColumn("_dq_reason", F.lit(reason))


@dataclass(frozen=True)
class Rule:
    """``kind``: row (SQL boolean), unique (comma list of columns), reference (column; needs ``parent``), trend (numeric column by ``at``)."""

    rule_id: str
    expression: str
    threshold: float = 100.0
    severity: str = "Warning"
    action: str = "Flag"
    kind: str = "row"
    parent: tuple[DataFrame, str] | None = None
    at: str | None = None
    days: int = 90
    deviations: float = 3.0


def _verdict(df: DataFrame, r: Rule) -> tuple[DataFrame, Column]:
    """The table, widened where the rule needs it, and the rule's boolean."""
    if r.kind == "row":
        return df, F.expr(r.expression)
    name = f"_q_{r.rule_id}".replace("-", "_")
    if r.kind == "unique":
        keys = [k.strip() for k in r.expression.split(",")]
        n = df.groupBy(*keys).agg(F.count("*").alias(name))
        cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(n[k]) for k in keys])
        return df.join(n, cond, "left").select(df["*"], n[name]), F.col(name) == 1
    if r.kind == "reference":
        parent, key = r.parent
        keys = parent.select(F.col(key).alias(name)).filter(f"{name} is not null").distinct()
        return df.join(keys, F.col(r.expression) == F.col(name), "left"), F.col(r.expression).isNull() | F.col(name).isNotNull()
    if r.kind == "trend":
        from pyspark.sql import Window

        w = Window.orderBy(F.unix_date(F.col(r.at))).rangeBetween(-r.days, -1)  # the table is one row per day
        mean, dev = F.avg(r.expression).over(w), F.stddev_samp(r.expression).over(w)
        wide = df.withColumn(name, mean.isNull() | dev.isNull() | (F.abs(F.col(r.expression) - mean) <= r.deviations * dev))
        return wide, F.col(name)
    raise ValueError(r.kind)


@contextmanager
def _quiet() -> Iterator[None]:
    log = logging.getLogger("SQLQueryContextLogger")
    before, log.disabled = log.disabled, True
    try:
        yield
    finally:
        log.disabled = before


def evaluate(df: DataFrame, rules: Iterable[Rule], *, batch_id: str | None = None) -> DataFrame:
    """One result row per rule; all row rules of a table share one aggregate.

    ``rule_id, severity, action, rows_evaluated, rows_passed, rows_failed, pass_rate_pct, is_breach, status``.
    A null verdict fails, an empty table passes with 100 %, an expression that cannot be
    resolved is a breach with status EXPRESSION_ERROR. With ``batch_id`` only rows of
    that batch count, if the table has a batch column.
    """
    spark = df.sparkSession
    for c in ("_batch_id", "batch_id"):
        if batch_id is not None and c in df.columns:
            df = df.filter(F.col(c) == batch_id)
            break
    good, broken = [], []
    wide = df
    for r in rules:
        # an expression that cannot be resolved is a result here, not an error to be logged
        with _quiet():
            try:
                w2, v = _verdict(wide, r)
                w2.select(v.cast("boolean"))
                wide = w2
                good.append((r, v))
            except AnalysisException:
                broken.append(r)
    passed = [F.count_if(F.coalesce(v.cast("boolean"), F.lit(False))).alias(f"p{i}") for i, (_, v) in enumerate(good)]
    one = wide.agg(F.count("*").alias("n"), *passed)
    rows = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"p{i}").alias("p"), F.lit("OK").alias("status")) for i, (r, _) in enumerate(good)]
    rows += [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"), F.lit(float(r.threshold)).alias("threshold"), F.lit(0).cast("long").alias("p"), F.lit("EXPRESSION_ERROR").alias("status")) for r in broken]
    if not rows:
        return spark.createDataFrame([], "rule_id string, severity string, action string, rows_evaluated long, rows_passed long, rows_failed long, pass_rate_pct double, is_breach boolean, status string")
    rate = F.when(F.col("status") != "OK", 0.0).when(F.col("n") == 0, 100.0).otherwise(F.round(F.col("r.p") * 100.0 / F.col("n"), 4))
    out = one.select("n", F.explode(F.array(*rows)).alias("r")).withColumn("status", F.col("r.status")).withColumn("rate", rate)
    return out.select(
        "r.rule_id", "r.severity", "r.action", F.col("n").alias("rows_evaluated"), F.col("r.p").alias("rows_passed"), (F.col("n") - F.col("r.p")).alias("rows_failed"),
        F.col("rate").alias("pass_rate_pct"), ((F.col("rate") < F.col("r.threshold")) | (F.col("status") != "OK")).alias("is_breach"), "status",
    )


def failing_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """Rows that fail a rule, marked with its id: what a breached 'Quarantine' rule writes out."""
    wide, v = _verdict(df, rule)
    return wide.filter(~F.coalesce(v.cast("boolean"), F.lit(False))).select(*df.columns).withColumn("_dq_rule_id", F.lit(rule.rule_id))


def breached_rows(df: DataFrame, rules: Iterable[Rule], results: DataFrame) -> DataFrame | None:
    """Rows to set aside: those failing a rule that is breached and whose action is 'Quarantine'; None if no rule asks for it.

    A row that fails several such rules comes once per rule.
    """
    hit = {r["rule_id"] for r in results.filter("is_breach and action = 'Quarantine' and status = 'OK'").select("rule_id").collect()}  # one row per rule
    parts = [failing_rows(df, r) for r in rules if r.rule_id in hit]
    return reduce(DataFrame.unionByName, parts) if parts else None


def with_rule_keys(results: DataFrame, dim_rule: DataFrame) -> DataFrame:
    """Surrogate keys of the rules; -1 where the catalogue lacks one."""
    d = dim_rule.select("rule_id", "dq_rule_key").dropDuplicates(["rule_id"])
    return results.join(d, "rule_id", "left").withColumn("dq_rule_key", F.coalesce("dq_rule_key", F.lit(-1)))


def gate(results: DataFrame) -> None:
    """Raise when a rule of severity Error that must stop the batch is breached, or cannot be evaluated."""
    fatal = results.filter("is_breach and severity = 'Error' and (action = 'FailBatch' or status = 'EXPRESSION_ERROR')").select("rule_id").collect()
    if fatal:
        raise QualityGateError("fatal rules breached: " + ", ".join(sorted(r[0] for r in fatal)))


def unmapped_codes(df: DataFrame, mapped: str, source_code: str, domain: str, system: str) -> DataFrame:
    """Source codes that mapped to UNKNOWN, with their counts."""
    return df.filter(F.col(mapped) == "UNKNOWN").groupBy(F.lit(domain).alias("domain"), F.lit(system).alias("source_system"), F.col(source_code).alias("source_code")).agg(F.count("*").alias("row_count"))


def reconcile(staged: DataFrame, committed: DataFrame, by: list[str]) -> DataFrame:
    """Per group the staged and committed counts where they differ."""
    a, b = staged.groupBy(*by).agg(F.count("*").alias("staged")), committed.groupBy(*by).agg(F.count("*").alias("committed"))
    both = a.join(b, by, "full").na.fill(0, ["staged", "committed"])
    return both.filter("staged <> committed")


def unknown_rates(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the unknown member per surrogate key, in percent, in one pass."""
    one = fact.agg(*[F.avg((F.col(k) == -1).cast("double")).alias(k) for k in keys])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.round(F.col(k) * 100, 4).alias("unknown_pct")) for k in keys])).alias("r")).select("r.*")


def resolution_rate(df: DataFrame, col: str) -> DataFrame:
    """Rows, resolved rows and their percentage."""
    return df.agg(F.count("*").alias("rows"), F.count(col).alias("resolved"), F.round(F.try_divide(F.count(col) * 100.0, F.count("*")), 4).alias("resolved_pct"))
