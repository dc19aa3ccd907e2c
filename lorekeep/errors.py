"""Typed errors: a bad record stops the whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


class LorekeepError(ValueError):
    """Base of all errors; ``code`` names the rule and ``row`` the first record that breaks it."""

    def __init__(self, code: str, row: dict | None = None) -> None:
        super().__init__(code if row is None else f"{code}: {row}")
        self.code, self.row = code, row


def assert_none(violations: DataFrame, code: str, *order: Column | str) -> None:
    """Raise for the first violating row in a total order; one row reaches the driver at most."""
    found = (violations.orderBy(*order) if order else violations).head(1)
    if found:
        raise LorekeepError(code, found[0].asDict(recursive=True))


def assert_rules(rows: DataFrame, rules: dict[str, Column], *order: Column | str) -> DataFrame:
    """Check several predicates in one pass: the first bad row, and its first broken rule, is raised."""
    from pyspark.sql import functions as F

    broken = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()))
    found = rows.withColumn("__broken", broken).where("__broken is not null")
    first = (found.orderBy(*order) if order else found).head(1)
    if first:
        row = first[0].asDict(recursive=True)
        raise LorekeepError(row.pop("__broken"), row)
    return rows
