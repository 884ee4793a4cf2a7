"""Row policies, column masks and grants."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_row_policy(df: DataFrame, *, user: str, scope: DataFrame, key: str, roles: DataFrame, bypass: Iterable[str] = ()) -> DataFrame:
    """Rows of the keys granted to the user; users with an all-scope or a bypass role see everything, others without grants nothing."""
    mine = roles.filter(F.col("user_principal_name") == user)
    if mine.filter(F.col("is_all_hospitals") | F.col("role_name").isin(*bypass)).limit(1).count():
        return df
    keys = scope.filter(F.col("user_principal_name") == user).select(key).distinct()
    return df.join(keys, key, "left_semi")


def partial_mask(c: Column | str, prefix: int, pad: str, suffix: int) -> Column:
    """First and last characters with padding between; short values show the padding only; null stays null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(c.isNull(), c).when(F.length(c) <= prefix + suffix, F.lit(pad)).otherwise(F.concat(F.substring(c, 1, prefix), F.lit(pad), F.right(c, F.lit(suffix)) if suffix else F.lit("")))


def default_mask(df: DataFrame, name: str) -> Column:
    """Zero for numbers, 'xxxx' for texts, 1900-01-01 for dates."""
    kind = df.schema[name].dataType.simpleString()
    if kind in ("string",):
        return F.lit("xxxx")
    if kind in ("date", "timestamp"):
        return F.lit("1900-01-01").cast(kind)
    return F.lit(0).cast(kind)


def mask(df: DataFrame, masks: Mapping[str, Column | str], *, roles: Iterable[str], unmask: Iterable[str]) -> DataFrame:
    """Masked columns unless one of the roles may see them; 'default' asks for the type's default mask."""
    if set(roles) & set(unmask):
        return df
    return df.withColumns({c: default_mask(df, c) if isinstance(m, str) else m for c, m in masks.items()})


def allowed_tables(grants: DataFrame, roles: Iterable[str]) -> DataFrame:
    """Tables granted to any of the roles and denied to none."""
    mine = grants.filter(F.col("role_name").isin(*roles))
    return mine.filter("effect = 'GRANT'").select("table_name").distinct().join(mine.filter("effect = 'DENY'").select("table_name").distinct(), "table_name", "left_anti")


def allowed_columns(df: DataFrame, table: str, hidden: DataFrame, roles: Iterable[str]) -> DataFrame:
    """``df`` without the columns that are hidden (``table_name, column_name, role_name``) from any of the roles."""
    mine = hidden.filter((F.col("table_name") == table) & F.col("role_name").isin(*roles)).select("column_name").distinct().collect()  # columns of one table
    return df.drop(*[r["column_name"] for r in mine])


def deidentified(fact: DataFrame, joins: Iterable[tuple[DataFrame, str]], keep: list[str]) -> DataFrame:
    """Star join on surrogate keys, reduced to columns without identifiers."""
    for dim, key in joins:
        fact = fact.join(dim, key)
    return fact.select(*keep)
