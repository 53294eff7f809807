"""Verdicts. Not understood is "no statement", never "confirmed"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIRMED, WARNING, SILENT, ERROR = "confirmed", "warning", "no statement", "error"
MINOR, NOTABLE, CRITICAL = 0, 1, 2


def cleaning(outcome: Column) -> Column:
    """Of complete, partial, unknown, malformed."""
    return F.when(outcome == "complete", CONFIRMED).when(outcome == "partial", WARNING).when(outcome == "malformed", ERROR).otherwise(SILENT)


def received(understood: Column, findings: Column, readable: Column) -> Column:
    return F.when(~readable, ERROR).when(~F.coalesce(understood, F.lit(False)), SILENT).when(findings > 0, WARNING).otherwise(CONFIRMED)


def sender(case: Column, signature_required: bool = False) -> Column:
    """Of the six cases of a resolved signer."""
    unsigned = ERROR if signature_required else SILENT
    return F.when(case == "verified", CONFIRMED).when(case.isin("seen", "changed"), WARNING).when(case == "revoked", ERROR).when(case == "unknown", SILENT).otherwise(unsigned)


def contact(state: Column) -> Column:
    """Of a contact in a list; a contact that was only seen says nothing here."""
    return F.when(state == "verified", CONFIRMED).when(state == "changed", WARNING).when(state == "revoked", ERROR).otherwise(SILENT)


def deletion(rotating: Column, copy_on_write: Column, virtual: Column) -> Column:
    """Overwriting is promised only where all three are known to allow it."""
    sure = F.coalesce(rotating, F.lit(False)) & ~F.coalesce(copy_on_write, F.lit(True)) & ~F.coalesce(virtual, F.lit(True))
    return F.when(sure, "overwrite").otherwise("best effort")


def countdown(remaining: Column, limit: Column) -> Column:
    """Warning level of a session that will lock: the last 30 seconds, a sixth, a third of the limit."""
    return F.when(remaining <= 0, "locked").when(remaining <= 30, "countdown").when(remaining * 6 <= limit, "strong").when(remaining * 3 <= limit, "soft").otherwise("none")
