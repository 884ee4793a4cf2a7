"""Outgoing feeds: daily batches, panels, chunks, totals, changed rows, next identifiers, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.conforming import surrogate_keys


def daily_batches(df: DataFrame, day: str, order: list[str], *, every: int = 7, days: int = 60, per_day: int = 400) -> DataFrame:
    """Every ``every``-th day that has rows, the first ``days`` of these, and of each at most ``per_day`` rows in order.

    The limits are the feature: an outgoing batch is bounded. Days are numbered over the days, not over the rows.
    """
    n = df.select(day).filter(F.col(day).isNotNull()).distinct()
    # one row per day in one task
    n = n.withColumn("_n", F.row_number().over(Window.orderBy(day)) - 1).filter((F.col("_n") % every == 0) & (F.col("_n") < every * days)).select(day)
    return df.join(n, day).withColumn("_r", F.row_number().over(Window.partitionBy(day).orderBy(*order))).filter(F.col("_r") <= per_day).drop("_r")


def panels(results: DataFrame, panel_of: DataFrame, *, code: str, by: list[str], order: str) -> DataFrame:
    """Results grouped into panels: codes in order; a code without a panel is a panel of its own."""
    p = panel_of.groupBy(F.col(code).alias("_c")).agg(F.min("panel").alias("_p"))
    x = results.join(p, F.col(code) == F.col("_c"), "left").withColumn("panel", F.coalesce("_p", code))
    return x.groupBy(*by, "panel").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, code))), lambda s: s[code]).alias("codes"))


def chunks(df: DataFrame, day: str, order: list[str], size: int = 200) -> DataFrame:
    """``chunk`` number from 0 of each row inside its day."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(day).orderBy(*order)) - 1) / size).cast("int"))


def file_totals(payments: DataFrame, file: str, status: Column, paid: str, statuses: dict[str, str], default: str = "1") -> DataFrame:
    """Paid total and claims per outgoing file and wire status; statuses without a code have the default."""
    m = F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])
    return payments.groupBy(file, F.coalesce(F.try_element_at(m, status), F.lit(default)).alias("wire_status")).agg(F.sum(paid).alias("paid"), F.count("*").alias("claims"))


def next_ids(current: DataFrame, fresh: DataFrame, *, key: str, prefix: str, order: list[str], width: int) -> DataFrame:
    """``fresh`` with new identifiers that go on after the greatest numeric suffix in use; texts without number do not count."""
    top = current.agg(F.coalesce(F.max(F.substring(key, len(prefix) + 1, 20).try_cast("bigint")), F.lit(0))).first()[0]
    return surrogate_keys(fresh, order, "_n", top).withColumn(key, F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), width, "0"))).drop("_n")


def literal(c: Column) -> Column:
    """SQL literal of a text: empty and null are NULL, quotes are doubled."""
    s = c.cast("string")
    return F.when(F.coalesce(s, F.lit("")) == "", "NULL").otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def insert_statements(df: DataFrame, table: str, columns: list[str], order: list[str], size: int = 500) -> DataFrame:
    """``batch, statement``: inserts of ``size`` rows each, rows in order."""
    numbered = surrogate_keys(df.select(*columns), order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int"))
    row = F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(c)) for c in columns]), F.lit(")"))
    head = f"INSERT INTO {table} ({', '.join(columns)}) VALUES "
    return numbered.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", row.alias("r")))), lambda x: x["r"]), ", ")).alias("statement"))


def changes(current: DataFrame, wanted: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """What a delta feed sends: ``new`` rows, ``changed`` rows and, as it is, what was delivered again (``redelivered``)."""
    old = current.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*tracked).alias("_old"))
    hit = None
    for k in keys:
        hit = (F.col(k) == F.col(f"_{k}")) if hit is None else hit & (F.col(k) == F.col(f"_{k}"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.struct(*tracked).eqNullSafe(F.col("_old")), "redelivered").otherwise("changed")
    return wanted.join(old, hit, "left").withColumn("change", kind).select(*wanted.columns, "change")
