"""Change logs of rule tables, and the audit trail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.alerts import matches_tokens

OPS = ("insert", "update", "delete")
Validator = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def judged_changes(table: DataFrame, log: DataFrame, validate: Validator) -> DataFrame:
    """``log`` with ``reject_reason``, null where the change is accepted.

    ``log`` is the table's columns plus ``op`` (insert, update, delete) and ``changed_at``.  Entries of an id are taken
    in the order of time and op: an id is there after a valid insert and gone after a delete, at first as the table
    says; updates and deletes of an absent id are rejected, and so are invalid rows and those of a null or other op.
    """
    deletes = log.filter(F.col("op") == "delete")
    unknown = log.filter(~F.coalesce(F.col("op").isin(*OPS), F.lit(False))).withColumn("reject_reason", F.lit("unknown op"))
    valid, invalid = validate(log.filter(F.col("op").isin("insert", "update")))
    known = table.select("id", F.lit(True).alias("_stored")).distinct()
    ties = [c for c in ("name", "scope", "target") if c in log.columns]
    earlier = Window.partitionBy("id").orderBy("changed_at", "op", *ties).rowsBetween(Window.unboundedPreceding, -1)
    effect = F.when(F.col("op") == "insert", True).when(F.col("op") == "delete", False)
    checked = valid.unionByName(deletes).join(known, "id", "left")
    there = F.coalesce(F.last(effect, ignorenulls=True).over(earlier), F.col("_stored"), F.lit(False))
    missing = (F.col("op") != "insert") & ~there
    checked = checked.withColumn("reject_reason", F.when(missing, "id not found")).drop("_stored")
    return checked.unionByName(invalid.select(*checked.columns)).unionByName(unknown.select(*checked.columns))


def apply_rule_changes(
    table: DataFrame, log: DataFrame, validate: Validator
) -> tuple[DataFrame, DataFrame]:
    """(table after the log, rejected log rows): the last accepted entry of an id decides."""
    judged = judged_changes(table, log, validate)
    ties = [F.desc(c) for c in ("name", "scope", "target") if c in log.columns]
    newest = Window.partitionBy("id").orderBy(F.desc("changed_at"), F.desc("op"), *ties)
    latest = (
        judged.filter("reject_reason is null")
        .withColumn("_n", F.row_number().over(newest))
        .filter("_n = 1")
        .drop("_n", "reject_reason")
    )
    untouched = table.join(latest.select("id"), "id", "left_anti")
    changed = latest.filter(F.col("op") != "delete").select(*table.columns)
    return (
        untouched.select(*table.columns).unionByName(changed),
        judged.filter("reject_reason is not null"),
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason is null").drop("reject_reason")


def _entry(log: DataFrame, action: Column, details: Column) -> DataFrame:
    return log.select(F.col("changed_at").alias("timestamp"), action.alias("action"), details.alias("details"))


def audit_labels(log: DataFrame) -> DataFrame:
    return _entry(
        log,
        F.lit("update_device_label"),
        F.format_string('label of %s is now "%s"', "ip", "label"),
    )


def audit_status(log: DataFrame) -> DataFrame:
    return _entry(
        log,
        F.lit("update_anomaly_status"),
        F.format_string('alert %d is now "%s"', "anomaly_id", "status"),
    )


def audit_rule_changes(log: DataFrame, kind: str) -> DataFrame:
    """``kind`` is ``policy`` or ``notification_rule``."""
    verb = F.when(F.col("op") == "delete", "delete").otherwise("save")
    return _entry(
        log,
        F.concat(verb, F.lit(f"_{kind}")),
        F.format_string(
            "id %d, name %s, scope %s, target %s",
            "id", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "scope", "target")],
        ),
    )


def audit_log(*parts: DataFrame) -> DataFrame:
    """One audit row per change; the parts come from ``accepted`` changes."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


AUDIT_KEY = ("timestamp", "action", "details")


def _newest_first(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("timestamp"), "action", "details")


def list_audit(audit: DataFrame, k: int = 50) -> DataFrame:
    return _newest_first(audit).limit(k)


def page_end(page: list, after: tuple | None = None) -> tuple | None:
    """``after`` of the page that follows ``page`` (its rows, not empty), itself read with ``after``."""
    if not page:
        return after
    last = tuple(page[-1][c] for c in AUDIT_KEY)
    shown = sum(tuple(r[c] for c in AUDIT_KEY) == last for r in page)
    if after is not None and len(after) > len(AUDIT_KEY) and tuple(after[: len(AUDIT_KEY)]) == last:
        shown += after[-1]
    return (*last, shown)


def search_audit(audit: DataFrame, q: str = "", after: tuple | None = None, size: int = 25) -> DataFrame:
    """One page of matching audit rows, newest first.

    ``after`` is (timestamp, action, details, shown): the last row of the pages before and how many rows equal to it
    they showed, see ``page_end``; so rows that repeat are lost at no border, and a page costs its own size and those
    repeats, not all pages before it.  Without ``shown`` the page begins behind all rows equal to the last one.
    """
    found = audit.filter(matches_tokens(q, ["action", "details"]))
    shown = 0
    if after is not None:
        at, action, details = (F.lit(x) if not isinstance(x, Column) else x for x in after[: len(AUDIT_KEY)])
        shown = after[-1] if len(after) > len(AUDIT_KEY) else 0
        border = F.col("details") >= details if shown else F.col("details") > details
        later = (F.col("action") > action) | ((F.col("action") == action) & border)
        found = found.filter((F.col("timestamp") < at) | ((F.col("timestamp") == at) & later))
    return _newest_first(found).offset(shown).limit(size)
