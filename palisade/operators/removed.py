"""Evidence that a change has removed a control at a finding's place, and the ordered merge of two reports.

Diffs become rows of lines; everything else is joins of these within a file or a scan: old
code is looked for on removed lines, its place in the new file is the deletion point, and
what stands anywhere in the new files was moved. Texts are compared in the form that
quotes are (`quotes.match_form`).

Results for special rows: rows with a null scan, path or line match nothing; a change
without old code counts for nothing; repeated changes give a row each, repeated
candidates too; empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

from . import diffs, intervals, quotes
from .names import top_per

# Lines about a finding outside any function, and about the old place of a quote (fixed values).
FALLBACK, QUOTE_WINDOW, QUOTE_LINES = 40, 60, 12

FILE = ["scan", "path"]


def form(text: Column) -> Column:
    """quotes.match_form of a column."""
    return F.pandas_udf(lambda s: s.map(quotes.match_form, na_action="ignore"), "string")(text)


def diff_rows(files: DataFrame) -> DataFrame:
    """files (scan, path, patch) to (scan, path, tag, old_line, new_line, text); new_line of a removed line is its deletion point."""
    diffs.use_small_batches(files.sparkSession)

    @F.pandas_udf("array<struct<tag:string,old_line:int,new_line:int,text:string>>")
    def rows(patches: pd.Series) -> pd.Series:
        def one(patch: str | None) -> list[dict]:
            out = []
            for a, b, body in diffs.hunks(patch or "", strict=False):
                for tag, text in body:
                    out.append({"tag": tag, "old_line": a if tag != "+" else None, "new_line": b, "text": text})
                    a, b = a + (tag != "+"), b + (tag != "-")
            return out

        return patches.map(one)

    return files.select(*FILE, F.explode(rows(F.col("patch"))).alias("x")).select(*FILE, "x.*")


def old_places(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates with old_line: where their line stood before the change."""
    back = F.pandas_udf(lambda patches, lines: pd.Series([None if pd.isna(n) else diffs.map_back(p or "", int(n)) for p, n in zip(patches, lines)], dtype="Int32"), "int")
    return candidates.join(files.select(*FILE, "patch"), FILE).withColumn("old_line", back("patch", "line")).drop("patch")


def scopes(candidates: DataFrame, functions: DataFrame, window: int = FALLBACK) -> DataFrame:
    """candidates with low, high (new lines), old_low, old_high (null if unknown) and in_function.

    functions (scan, path, start_line, end_line, old_start, old_end), the outermost around
    the line counts; without one it is the lines about the candidate.
    """
    inside = intervals.innermost(candidates.select(*FILE, "id", "line"), functions, FILE, ["scan", "id"], "line", "start_line", "end_line", "start_line", outermost=True)
    out = candidates.join(inside.select("scan", "id", "start_line", "end_line", "old_start", "old_end"), ["scan", "id"], "left")
    last = F.coalesce("end_line_of", "line")
    return out.select(
        *candidates.columns, F.col("start_line").isNotNull().alias("in_function"), F.coalesce("start_line", F.col("line") - window).alias("low"),
        F.coalesce("end_line", last + window).alias("high"), F.col("old_start").alias("old_low"), F.col("old_end").alias("old_high"),
    )


def _in_files(forms: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(scan, path, forms, targets) of files: where each form of forms (scan, path, form) is removed, if it is still there, and old lines of candidates.

    Texts are brought together once, without white space, and of a patch only removed lines
    and tags; what is found in them is numbers and digests.
    """
    diffs.use_small_batches(files.sparkSession)

    @F.pandas_udf("gone array<struct<line:int,at:int,form:string>>, tags string")
    def read(patches: pd.Series) -> pd.DataFrame:
        def one(patch: str | None) -> tuple[list[dict], str]:
            gone = []
            for a, b, body in diffs.hunks(patch or "", strict=False):
                for tag, text in body:
                    if tag == "-":
                        gone.append({"line": a, "at": b, "form": quotes.match_form(text)})
                    a, b = a + (tag != "+"), b + (tag != "-")
            return gone, "\n".join(line if diffs.HUNK.match(line) else line[:1] for line in (patch or "").split("\n"))

        return pd.DataFrame([one(p) for p in patches], columns=["gone", "tags"])

    @F.pandas_udf("array<struct<line:int,target:int>>")
    def back(tags: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([[{"line": int(n), "target": diffs.map_back(t, int(n))} for n in numbers] for t, numbers in zip(tags, lines)])

    each = files.select(*FILE, form(F.col("new")).alias("whole"), read("patch").alias("x")).select(*FILE, "whole", "x.*")
    asked = forms.groupBy(*FILE).agg(F.collect_set("form").alias("forms"))
    lines = candidates.filter("line is not null").groupBy(*FILE).agg(F.collect_set(F.col("line").cast("int")).alias("lines"))
    found = F.transform("forms", lambda f: F.struct(
        _digest(f).alias("digest"), F.transform(F.filter("gone", lambda g: F.contains(g["form"], f)), lambda g: F.struct(g["line"].alias("line"), g["at"].alias("at"))).alias("gone"),
        F.coalesce(F.contains("whole", f), F.lit(False)).alias("moved"),
    ))
    return each.join(asked, FILE, "left").join(lines, FILE, "left").filter("forms is not null or lines is not null").select(
        *FILE, found.alias("forms"), F.when(F.col("lines").isNotNull(), back("tags", F.coalesce("lines", F.array().cast("array<int>")))).alias("targets"),
    )


def _digest(form: Column) -> Column:
    return F.unhex(F.md5(form))


def removal_checks(candidates: DataFrame, changes: DataFrame, files: DataFrame, functions: DataFrame, window: int = FALLBACK) -> DataFrame:
    """(scan, id, change, old_line, new_line, reason): each change of a candidate's unit, and why it is no evidence; null if it is.

    candidates (scan, id, path, line, end_line); changes (scan, change, path, start_line,
    end_line, direction, old_text, line, alert), of units that lost a guard, with the
    unit's lines; files (scan, path, new, patch). Old texts are known by 128-bit digests of
    their form once they were looked for in the files.
    """
    scratch = Scratch(files.sparkSession, "evidence")
    wanted = changes.select("scan", "path", "change", "start_line", "end_line", "direction", F.col("line").alias("anchor"), F.coalesce("alert", F.lit(False)).alias("alert"), form(F.col("old_text")).alias("form"))
    forms = wanted.filter("form <> ''").select(*FILE, "form")
    facts = scratch.save(_in_files(forms, candidates, files), "facts", compression="zstd")
    wanted = scratch.save(wanted.withColumn("digest", F.when(F.col("form") != "", _digest(F.col("form")))).drop("form"), "wanted", compression="zstd")
    found = facts.select(*FILE, F.explode("forms").alias("x")).select(*FILE, "x.*").groupBy(*FILE, "digest").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.bool_or("moved").alias("here"))
    # what a report says already: old lines of alerts, and their own lines
    alerts = wanted.filter("alert and digest is not null").select(*FILE, "digest").distinct()
    told_old = found.join(alerts, [*FILE, "digest"], "left_semi").select(*FILE, F.explode("gone.line").alias("old_line")).distinct().withColumn("told_old", F.lit(True))
    told_new = wanted.filter("alert and anchor is not null").select(*FILE, "anchor").distinct().withColumn("told_new", F.lit(True))

    targets = facts.select(*FILE, F.explode("targets").alias("x")).select(*FILE, "x.*")
    at = scopes(candidates.withColumnRenamed("end_line", "end_line_of").join(targets, [*FILE, "line"]), functions, window)
    pairs = at.join(wanted.filter(F.col("direction").isin("removed", "weakened")), FILE).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    near = F.array_min(F.transform("gone", lambda x: F.struct(F.abs(x["line"] - F.col("target")).alias("far"), x["line"].alias("line"), x["at"].alias("at"))))
    out = pairs.join(found, [*FILE, "digest"], "left").withColumn("near", near).withColumn("old_line", F.col("near.line")).withColumn("new_line", F.coalesce("anchor", "near.at")).drop("gone", "near")
    out = out.join(told_old, [*FILE, "old_line"], "left").join(told_new, [*FILE, "anchor"], "left")
    moved = F.coalesce("here", F.lit(False))
    # a scan of several files: what stands in another one was moved as well
    several = scratch.save(files.groupBy("scan").agg(F.count("*").alias("n")).filter("n > 1").select("scan"), "several")
    if several.limit(1).count():
        whole = files.join(several, "scan", "left_semi").select("scan", form(F.col("new")).alias("whole"))
        there = whole.join(forms.join(several, "scan", "left_semi").select("scan", "form").distinct(), "scan").filter(F.contains("whole", "form"))
        out = out.join(there.select("scan", _digest(F.col("form")).alias("digest")).distinct().withColumn("there", F.lit(True)), ["scan", "digest"], "left")
        moved = moved | F.coalesce("there", F.lit(False))
    by_old = F.col("anchor").isNull() & F.col("old_line").isNotNull() & F.col("old_low").isNotNull()
    in_scope = F.when(by_old, F.col("old_line").between(F.col("old_low"), F.col("old_high"))).otherwise(F.col("new_line").between(F.col("low"), F.col("high")))
    told = F.col("alert") | F.coalesce("told_old", F.lit(False)) | F.coalesce("told_new", F.lit(False))
    reason = (
        F.when(F.col("digest").isNull(), "no_old_code").when(F.col("new_line").isNull(), "not_located")
        .when(~in_scope, F.when(F.col("in_function"), "other_function").otherwise("too_far")).when(moved, "moved").when(told, "alert_reported")
    )
    return out.select("scan", "id", "change", "old_line", "new_line", reason.alias("reason"))


def quoted_controls(candidates: DataFrame, files: DataFrame, controls: DataFrame, comments: DataFrame, told: DataFrame, window: int = QUOTE_WINDOW, most: int = QUOTE_LINES) -> DataFrame:
    """(scan, id, first_line, last_line, text) of quotes that a change has removed and that look like a control.

    candidates (scan, id, path, line, quote), files (scan, path, old, new, patch); controls,
    comments and told (scan, path, line) are old lines that look like controls, that are
    comments, and that an alert has told of. The quote must lie about the candidate's old
    place, wholly on removed lines of code, and nowhere in the new files.
    """
    lines = F.split("old", r"\r\n|\r|\n")
    at = old_places(candidates, files).join(files.select(*FILE, "old"), FILE).filter(F.col("old_line").isNotNull() & (F.size(F.split("quote", "\n")) <= most))
    at = at.withColumn("from", F.greatest(F.col("old_line") - 1 - window, F.lit(0))).withColumn("code", F.array_join(F.slice(lines, F.col("from") + 1, F.col("old_line") + window - F.col("from")), "\n"))
    # as it is, else without the marks of removed lines
    bare = F.regexp_replace("quote", r"(?m)^-", "")
    at = at.withColumn("reading", F.explode(F.array_distinct(F.array("quote", bare)))).withColumn("second", F.col("reading") != F.col("quote"))
    found = top_per(quotes.with_location(at, "reading", "code").filter("first_line is not null"), ["scan", "id"], ["second"])
    found = found.select(*FILE, "id", "reading", "old", (F.col("from") + F.col("first_line")).alias("first_line"), (F.col("from") + F.col("last_line")).alias("last_line"))
    each = found.select(*FILE, "id", F.posexplode(F.split("old", r"\r\n|\r|\n")).alias("i", "text"), "first_line", "last_line").withColumn("line", F.col("i") + 1)
    each = each.filter(F.col("line").between(F.col("first_line"), F.col("last_line")) & (F.trim("text") != ""))
    mark = lambda df, name: df.select(*FILE, "line").distinct().withColumn(name, F.lit(True))
    gone = diff_rows(files).filter("tag = '-'").select(*FILE, F.col("old_line").alias("line"))
    for name, df in (("is_gone", gone), ("is_comment", comments), ("is_control", controls), ("is_told", told)):
        each = each.join(mark(df, name), [*FILE, "line"], "left")
    no = F.lit(False)
    judged = each.groupBy("scan", "id").agg(
        F.bool_and(F.coalesce("is_gone", no) & ~F.coalesce("is_comment", no)).alias("all_gone"), F.bool_or(F.coalesce("is_control", no)).alias("control"), F.bool_or(F.coalesce("is_told", no)).alias("told"),
    )
    rows = found.join(judged, ["scan", "id"]).filter("all_gone and control and not told").withColumn("form", form(F.col("reading")))
    still = rows.select("scan", "id", "form").join(files.select("scan", form(F.col("new")).alias("whole")), "scan").filter(F.col("whole").contains(F.col("form"))).select("scan", "id").distinct()
    rows = rows.join(still, ["scan", "id"], "left_anti")
    text = F.array_join(F.slice(F.split("old", r"\r\n|\r|\n"), F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")
    return rows.select("scan", "id", "first_line", "last_line", text.alias("text"))


def merged_in_order(old: DataFrame, new: DataFrame, group: list[str], order: str, id_: str, same: Callable[[pd.Series, pd.Series], bool]) -> DataFrame:
    """(group…, old_id, new_id): each old row with the next new row of its group if they are the same; null where there is none.

    Both sides are gone through once in their order: an old row that is not the same as the
    next new one is left over, and the new one waits for the next old row. Rows of one
    group (a file's report) are merged in one task.
    """

    def merge(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.sort_values([order, id_], kind="stable") for x in (a, b))
        waiting, pairs = list(b.iterrows()), []
        for _, row in a.iterrows():
            if waiting and same(row, waiting[0][1]):
                pairs.append((*key, row[id_], waiting.pop(0)[1][id_]))
            else:
                pairs.append((*key, row[id_], None))
        pairs += [(*key, None, row[id_]) for _, row in waiting]
        return pd.DataFrame(pairs, columns=[*group, "old_id", "new_id"], dtype=object)

    kinds = {f.name: f.dataType.simpleString() for f in old.schema}
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in group] + [f"old_id {kinds[id_]}", f"new_id {new.schema[id_].dataType.simpleString()}"])
    return old.groupBy(*group).cogroup(new.groupBy(*group)).applyInPandas(merge, schema)
