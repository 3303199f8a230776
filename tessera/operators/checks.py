"""Many checks of a table in one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, functions as F

from tessera.operators.runs import summary


def run_checks(table: DataFrame, checks: dict[str, Callable[[], Column]]) -> DataFrame:
    """(ord, check, passed, error, line) of checks, in their order. A check gives an aggregate of the table that is true where it passes;
    one that is null, or that raises an error, has failed, and the others are told all the same.

    All checks are metrics of one scan (`observe`), so the table is read once however many there are. Only where that scan
    fails are they run one by one, to find the ones that raise.
    """
    errors, fine = {}, {}
    for name, check in checks.items():
        try:
            table.agg(check()).schema  # resolves names and types without reading
            fine[name] = check()
        except Exception as e:  # whatever the check raises is its outcome
            errors[name] = _said(e)
    found: dict[str, bool | None] = {}
    try:
        found = _observed(table, fine)
    except PySparkException:
        for name, column in fine.items():
            try:
                found |= _observed(table, {name: column})
            except PySparkException as e:
                errors[name] = _said(e)
    rows = [(k, name, found.get(name), errors.get(name)) for k, name in enumerate(checks)]
    return summary(table.sparkSession.createDataFrame(rows, "ord int, check string, passed boolean, error string"))


def _observed(table: DataFrame, columns: dict[str, Column]) -> dict[str, bool | None]:
    if not columns:
        return {}
    seen = Observation()
    table.observe(seen, *[c.cast("boolean").alias(f"c{k}") for k, c in enumerate(columns.values())]).write.format("noop").mode("overwrite").save()
    got = seen.get
    return {name: got[f"c{k}"] for k, name in enumerate(columns)}


def _said(e: Exception) -> str:
    return (e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__
