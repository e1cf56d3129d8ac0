"""Reports: findings as markup, notes on coverage, rows of matches.

A report is one row per scan. Its findings are gathered per scan, which a review caps.
Special rows: a scan without findings is clean only if its review is complete; null
fields are left out; every text is escaped; ties keep the order of `id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.scalars import SEVERITY, lookup

LISTED = 10


def banner(status: Column, total: Column, left: Column, partial: Column) -> Column:
    """One line on an incomplete review, else null."""
    bits = F.concat_ws(", ", F.when(left > 0, F.concat_ws(" ", left, F.lit("of"), total, F.lit("unit(s) not reviewed"))), F.when(partial > 0, F.concat_ws(" ", partial, F.lit("only partly reviewed"))))
    return (
        F.when(status == "failed", F.concat(F.lit("**Review failed: none of the "), total.cast("string"), F.lit(" unit(s) was reviewed.** Nothing found does not mean that the code is clean.")))
        .when(status == "partial", F.concat(F.lit("**Partial review: "), F.when(bits == "", "coverage incomplete").otherwise(bits), F.lit(".** Findings cover the reviewed code only.")))
    )


def finding_lines(f: Column) -> Column:
    """A finding (severity, title, file_path, line, cwe, explanation, quoted_code, fix_snippet, …) as lines of markup."""
    known = F.lower(f["severity"]).isin(*SEVERITY)
    badge = F.when(known, F.concat(F.lit("`"), F.upper(f["severity"]), F.lit("` "))).otherwise("")
    where = F.when(f["file_path"].isNotNull(), F.concat(f["file_path"], F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), F.lit("")))).otherwise(F.concat(F.lit("line "), f["line"].cast("string")))
    refs = F.concat_ws(", ", F.when(where.isNotNull(), T.code_span(where)), F.when(f["cwe"].isNotNull(), T.inline(f["cwe"])))
    head = F.concat(F.lit("- **"), badge, T.inline(F.coalesce(F.when(f["title"] != "", f["title"]), F.lit("Security finding"))), F.lit("**"), F.when(refs != "", F.concat(F.lit(" ("), refs, F.lit(")"))).otherwise(""))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    lines = F.array(head, F.when(some(f["explanation"]), F.concat(F.lit("  "), T.inline(f["explanation"]))), F.when(some(f["quoted_code"]), F.concat(F.lit("  - Code: "), T.code_span(f["quoted_code"]))))
    fix = F.when(some(f["fix_snippet"]), F.concat(F.array(F.lit("  - Suggested fix:")), T.code_block(F.trim(f["fix_snippet"]), "    "))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(lines, lambda x: x.isNotNull()), fix)


FINDING = ("severity", "title", "file_path", "line", "cwe", "explanation", "quoted_code", "fix_snippet")


def reports(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """scans (scan, status, total, not_reviewed, partial), findings (scan, id, source, …) to (scan, body)."""
    rank = F.coalesce(lookup(SEVERITY, F.lower("severity")), F.lit(-1))
    rows = findings.select("scan", F.struct((-rank).alias("r"), "id", F.coalesce(F.col("source") == "guard_diff", F.lit(False)).alias("sure"), *FINDING).alias("f"))
    by_scan = rows.groupBy("scan").agg(F.array_sort(F.collect_list("f")).alias("fs"))  # a scan's findings, which the review caps
    both = scans.join(by_scan, "scan", "left").withColumn("fs", F.coalesce("fs", F.filter(F.array(F.lit(None).cast(by_scan.schema["fs"].dataType.elementType)), lambda x: F.lit(False))))
    part = lambda sure, title: F.when(F.exists("fs", lambda f: f["sure"] == sure), F.concat(F.array(F.lit(title)), F.flatten(F.transform(F.filter("fs", lambda f: f["sure"] == sure), finding_lines)))).otherwise(F.array().cast("array<string>"))
    note = banner(F.col("status"), F.col("total"), F.col("not_reviewed"), F.col("partial"))
    reviewed = F.col("total") - F.col("not_reviewed")
    footer = F.concat(F.lit("_"), reviewed.cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" unit(s) reviewed._"))
    empty = F.when(note.isNull(), "No security findings in the reviewed code.").when(F.col("status") == "failed", "No deterministic findings.").otherwise("No security findings in the code that was reviewed.")
    body = F.concat(F.array(F.lit("## Security report")), F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>")), F.when(F.size("fs") == 0, F.array(empty)).otherwise(F.concat(part(False, "### Review findings"), part(True, "### Removed guards (deterministic check)"))), F.array(footer))
    return both.select("scan", F.array_join(body, "\n").alias("body"))


def leftovers(units: DataFrame, by: list[str], reason: str, name: str, most: int = LISTED) -> DataFrame:
    """One note per reason: how many units are left out, the first names, and how many more."""
    from .names import top_per

    n = units.groupBy(*by, reason).agg(F.count("*").alias("n"))
    first = top_per(units.select(*by, reason, name), [*by, reason], [name], most).groupBy(*by, reason).agg(F.array_sort(F.collect_list(name)).alias("_names"))
    text = F.concat(F.col("n").cast("string"), F.lit(" unit(s) not reviewed ("), F.col(reason), F.lit("): "), F.array_join("_names", ", "), F.when(F.col("n") > F.size("_names"), F.concat(F.lit(" and "), (F.col("n") - F.size("_names")).cast("string"), F.lit(" more"))).otherwise(""))
    return n.join(first, [*by, reason]).select(*by, reason, "n", text.alias("note"))


def match_rows(matches: DataFrame) -> DataFrame:
    """Matches as stored rows: scores with null where nothing was scored, and the band of the advisory's score."""
    return matches.select("scan", "point_id", "source", "similarity_score", "rerank_prob", F.coalesce("rerank_prob", "similarity_score").alias("relevance"), "adjusted_score", T.severity_band(F.col("cvss")).alias("severity"))


def flat_hits(units: DataFrame, hits: str = "hits") -> DataFrame:
    """A row for each hit of a unit's array of hits; units without any give none."""
    kept = [c for c in units.columns if c != hits]
    return units.select(*kept, F.explode(hits).alias("_hit")).select(*kept, "_hit.*")


def kept_hits(hits: DataFrame, least: str, excluded: list[str]) -> DataFrame:
    """Hits (rule_id, severity) at a severity or above whose rule is not excluded, with low_confidence for rules about patterns."""
    rank = F.coalesce(lookup(SEVERITY, F.lower("severity")), F.lit(0))
    out = hits.filter(rank >= SEVERITY[least]).filter(~F.coalesce(F.col("rule_id").isin(*excluded), F.lit(False)) if excluded else F.lit(True))
    return out.withColumn("low_confidence", F.coalesce(F.col("rule_id").rlike("(?i)regex|redos|regexp"), F.lit(False)))


def unit_rows(units: DataFrame, matches: DataFrame, hits: DataFrame, guards: DataFrame) -> DataFrame:
    """Units (scan, path, name, start_line, position) with their matches, hits and guard, by path, name (null is a name) and line.

    A match without an anchor belongs to the scan's first unit. Counts and the best scores
    are joined, so that a unit with many matches is one row.
    """
    key = ["scan", "path", "name", "line"]
    own = units.withColumn("line", F.coalesce("start_line", F.lit(1)))
    first = own.groupBy("scan").agg(F.min_by(F.struct("path", "name", "line"), "position").alias("_first"))
    loose = matches.join(first, "scan")
    anchored = F.when(F.col("path").isNotNull(), F.struct("path", "name", F.coalesce("line", F.lit(1)).alias("line"))).otherwise(F.col("_first"))
    m = loose.select("scan", anchored.alias("_a"), "score").select("scan", "_a.path", "_a.name", "_a.line", "score").groupBy(*key).agg(F.count("*").alias("n_matches"), F.max("score").alias("best_score"))
    h = hits.withColumn("line", F.coalesce("line", F.lit(1))).groupBy(*key).agg(F.count("*").alias("n_hits"), F.bool_or(~F.col("low_confidence")).alias("sure_hit"))
    g = guards.withColumn("line", F.coalesce("line", F.lit(1))).groupBy(*key).agg(F.max("risk").alias("risk"), F.bool_or("alert").alias("alert"))
    out = own
    for side in (m, h, g):
        on = [out[c].eqNullSafe(side[c]) for c in key]
        out = out.join(side, on, "left").select(*[out[c] for c in out.columns], *[side[c] for c in side.columns if c not in key])
    zero = {c: 0 for c in ("n_matches", "n_hits")}
    return out.na.fill(zero)


def unit_priority() -> list[Column]:
    """Order of units: alerts, sure hits, removed guards, then the best match."""
    yes = lambda c: F.desc(F.coalesce(F.col(c), F.lit(False)))
    return [yes("alert"), yes("sure_hit"), F.desc(F.coalesce(F.col("risk") == "weakened", F.lit(False))), F.desc(F.coalesce("best_score", F.lit(0.0)))]
