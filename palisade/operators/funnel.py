"""Filters that say why, review funnels, gates, coverage and comment plans.

A check that is null does not fail. Empty tables give empty tables; a null scan is a scan;
ties go to the smaller id; repeated candidates are copies of each other; columns of any
name are kept where rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.scalars import SEVERITY, lookup

from .names import fresh, ranked, top_per

REPORT_AT, AUDIT_FLOOR, SUGGESTION_FLOOR, VERIFIER_CAP = 7, 5, 4, 8


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first failing check's name, else null."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(checks):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def all_reasons(checks: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(fails, F.lit(name)) for name, fails in checks]), lambda x: x.isNotNull())


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY, F.lower(severity))


def gate(findings: DataFrame, by: list[str], least: str) -> DataFrame:
    """Whether a finding of each group is at or above a severity."""
    return findings.groupBy(*by).agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= SEVERITY[least]), F.lit(False)).alias("fails"))


def funnel(candidates: DataFrame, scan: str, keys: list[str], cap: int = VERIFIER_CAP) -> DataFrame:
    """Adds `status`, which parts the candidates of each scan.

    Duplicates go first (most severe, then most confident, stays), then exclusions, then
    those under the audit floor (a missing confidence counts as the floor), then those
    beyond the verifier cap; verdicts part the rest. Only the cap's best of a scan are
    ranked, and the last of them is what the others are compared with, so that a scan may
    have any number of candidates; those of one id stand or fall together.
    """
    confidence = F.coalesce("confidence", F.lit(AUDIT_FLOOR))
    order = [F.desc(F.coalesce(severity_rank(F.col("severity")), F.lit(-1))), F.desc(confidence), "id"]
    copy, open_, last, of = (fresh(n, candidates) for n in ("copy", "open", "last", "of"))
    rows = ranked(candidates, [scan, *keys], order, copy).withColumn(copy, F.col(copy) > 1)
    rows = rows.withColumn(open_, ~F.col(copy) & F.col("exclusion").isNull() & (confidence >= AUDIT_FLOOR))
    worth = F.struct(-F.coalesce(severity_rank(F.col("severity")), F.lit(-1)), -confidence, F.col("id"))
    best = top_per(rows.filter(open_), [scan], order, cap).groupBy(F.col(scan).alias(of)).agg(F.max(worth).alias(last))
    rows = rows.join(best, F.col(scan).eqNullSafe(F.col(of)), "left")
    verdict = F.col("verdict")
    status = (
        F.when(F.col(copy), "duplicate").when(F.col("exclusion").isNotNull(), "excluded").when(confidence < AUDIT_FLOOR, "below_floor")
        .when(worth > F.col(last), "over_cap").when(verdict.isNull(), "not_verified")
        .when((verdict == "confirmed") & (confidence >= REPORT_AT), "confirmed").when(verdict == "confirmed", "low_confidence").when(verdict == "uncertain", "uncertain").otherwise("rejected")
    )
    return rows.withColumn("status", status).drop(copy, open_, last, of)


def suggested(verdict: Column, confidence: Column, evidence: Column, least: int = REPORT_AT, floor: int = SUGGESTION_FLOOR) -> Column:
    """Whether a claim that is not reported may be suggested: uncertain from the floor on or confirmed below the cut, with evidence."""
    sure = F.coalesce(confidence, F.lit(0))
    return F.coalesce(evidence, F.lit(False)) & F.coalesce(((verdict == "uncertain") & (sure >= floor)) | ((verdict == "confirmed") & (sure < least)), F.lit(False))


def disambiguated(rows: DataFrame, keys: list[str], key: str, order: list) -> DataFrame:
    """Rows whose identity repeats within the keys get `#2`, `#3`, … behind it, in the order."""
    n = fresh("n", rows)
    out = ranked(rows, [*keys, key], order, n)
    return out.withColumn(key, F.when(F.col(n) > 1, F.concat(F.col(key), F.lit("#"), F.col(n).cast("string"))).otherwise(F.col(key))).drop(n)


def coverage(units: DataFrame, scan: str) -> DataFrame:
    """complete, failed or partial for each scan from its units' states."""
    out = units.groupBy(scan).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "reviewed").alias("reviewed"), F.count_if(F.col("state") == "partial").alias("partial"))
    status = F.when(F.col("total") == 0, "complete").when(F.col("reviewed") + F.col("partial") == 0, "failed").when(F.col("reviewed") < F.col("total"), "partial").otherwise("complete")
    return out.withColumn("status", status)


def comment_plan(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """existing (comment_id, marker, body), desired (marker, body) to create, update, keep or delete."""
    have = ranked(existing, ["marker"], ["comment_id"], "n").select("comment_id", F.col("marker").alias("old_marker"), F.col("body").alias("old"), "n")
    want = desired.select("marker", F.col("body").alias("new"), F.lit(True).alias("wanted"))
    both = have.join(want, F.col("old_marker").eqNullSafe(F.col("marker")), "full_outer").withColumn("marker", F.coalesce("marker", "old_marker"))
    op = (
        F.when(F.col("wanted").isNull() | (F.col("n") > 1), "delete").when(F.col("comment_id").isNull(), "create")
        .when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    )
    return both.select("marker", "comment_id", op.alias("op"))
