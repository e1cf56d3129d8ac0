"""Unified diffs: parsing, applying, reversing, line mapping; Arrow-batched per text.

A side of a hunk without lines names the line before it; here both starts are the line at
which the side's lines stand, or would stand. Results for special rows: a null text is an
empty one, a null patch has no hunks; a patch that does not fit gives null and its error;
every row gives one row, and other columns are kept.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import linediff

#: Bytes of texts that a Python worker gets at once; as objects, with patches and rows of lines, they are many times that.
BATCH_BYTES = 4 << 20

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class BadPatch(ValueError):
    pass


def hunks(patch: str, strict: bool = True) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(old start, new start, [(tag, text)]) of each hunk; a strict read checks the counts."""
    lines, i = patch.split("\n"), 0
    while i < len(lines):
        m = HUNK.match(lines[i])
        i += 1
        if not m:
            continue
        old, new = int(m[2] or 1), int(m[4] or 1)
        body: list[tuple[str, str]] = []
        while i < len(lines) and (old > 0 or new > 0):
            tag, text = (lines[i][:1] or " "), lines[i][1:]
            if tag == "\\":
                i += 1
                continue
            if tag not in " +-":
                break
            old -= tag != "+"
            new -= tag != "-"
            body.append((tag, text))
            i += 1
        if strict and (old or new):
            raise BadPatch("hunk ends early")
        yield int(m[1]) + (m[2] == "0"), int(m[3]) + (m[4] == "0"), body


def diff_rows(patch: str) -> list[tuple[int, str, int | None, int | None, str]]:
    """(hunk, tag, old line, new line, text) of each line."""
    out = []
    for k, (a, b, body) in enumerate(hunks(patch, strict=False)):
        for tag, text in body:
            out.append((k, tag, a if tag != "+" else None, b if tag != "-" else None, text))
            a += tag != "+"
            b += tag != "-"
    return out


def apply(text: str, patch: str, reverse: bool = False) -> str:
    """The text after (or, reversed, before) the patch; every context and removed line must match."""
    source, out, at = text.split("\n"), [], 0
    gone, came = ("+", "-") if reverse else ("-", "+")
    for old, new, body in hunks(patch):
        start = (new if reverse else old) - 1
        if start < at:
            raise BadPatch("hunks overlap")
        out += source[at:start]
        at = start
        for tag, line in body:
            if tag != came:
                if at >= len(source) or source[at] != line:
                    raise BadPatch(f"line {at + 1} differs")
                at += 1
            if tag != gone:
                out.append(line)
    return "\n".join(out + source[at:])


def make(old: str, new: str, context: int = 3) -> str:
    """The patch from one text to the other; empty if they are equal."""
    a, b = old.split("\n"), new.split("\n")
    out = []
    for a0, a1, b0, b1, ops in linediff.grouped(linediff.opcodes(a, b), context):
        # a side without lines names the line before it, and a count of one is left out
        side = lambda low, high: f"{low + (high > low)}" + ("" if high - low == 1 else f",{high - low}")
        out.append(f"@@ -{side(a0, a1)} +{side(b0, b1)} @@")
        for tag, i1, i2, j1, j2 in ops:
            if tag == "equal":
                out += [" " + line for line in a[i1:i2]]
            else:
                out += ["-" + line for line in a[i1:i2]] + ["+" + line for line in b[j1:j2]]
    return "\n".join(["--- a", "+++ b", *out]) if out else ""


def touched(patch: str) -> list[int]:
    """New-file lines added, and for removed runs the lines before (if any) and after."""
    out: set[int] = set()
    for _, at, body in hunks(patch, strict=False):
        removed = False
        for tag, _ in body:
            if tag == "-":
                if not removed:
                    out |= {at - 1} if at > 1 else set()
                removed = True
                continue
            if removed:
                out.add(at)
            removed = False
            if tag == "+":
                out.add(at)
            at += 1
        if removed:
            out.add(at)
    return sorted(out)


def added(patch: str) -> list[int]:
    return [new for _, tag, _, new, _ in diff_rows(patch) if tag == "+"]


def map_line(patch: str, line: int) -> int:
    """Where an old line stands in the new file; a removed one maps to the place it left."""
    shift = 0
    for old, new, body in hunks(patch, strict=False):
        if line < old:
            break
        a, b = old, new
        for tag, _ in body:
            if tag != "+" and a == line:
                return b
            a += tag != "+"
            b += tag != "-"
        shift = b - a
    return line + shift


def map_back(patch: str, line: int) -> int:
    """Where a new line stood in the old file; an added one maps to the place it came to."""
    shift = 0
    for old, new, body in hunks(patch, strict=False):
        if line < new:
            break
        a, b = old, new
        for tag, _ in body:
            if tag != "-" and b == line:
                return a
            a += tag != "+"
            b += tag != "-"
        shift = a - b
    return line + shift


def removed(patch: str) -> list[int]:
    """Removed old-file lines."""
    return [old for _, tag, old, _, _ in diff_rows(patch) if tag == "-"]


def commentable(patch: str) -> list[int]:
    """New-file lines that the diff shows: added ones and context."""
    return [new for _, tag, _, new, _ in diff_rows(patch) if tag != "-"]


def ranges(patch: str, deletions: bool = False) -> list[tuple[int, int]]:
    """New-file ranges of the hunks; pure deletions as the lines around them, if wanted at all."""
    out = []
    for _, new, body in hunks(patch, strict=False):
        n = sum(t != "-" for t, _ in body)
        if n:
            out.append((new, new + n - 1))
        elif deletions:
            out.append((max(new - 1, 1), new))
    return out


def changed(code: str, other: str, context: int = 1) -> list[int] | None:
    """Lines of `code` that the change to `other` touches, compared without indentation; an insertion has `context` lines on either side."""
    a, b = ([x.strip() for x in t.splitlines()] for t in (code or "", other or ""))
    out: set[int] = set()
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal" and (any(a[i1:i2]) or any(b[j1:j2])):
            out.update(range(i1 + 1, i2 + 1) if i2 > i1 else range(max(1, i1 - context + 1), min(len(a), i1 + context) + 1))
    return sorted(out) or None


LINES = "added array<int>, removed array<int>, touched array<int>, commentable array<int>, first array<int>, last array<int>"


def with_lines(rows: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds diff.added, removed, touched and commentable lines and the hunks' new ranges of each patch."""

    def one(p):
        p = p or ""
        spans = ranges(p)
        return {"added": added(p), "removed": removed(p), "touched": touched(p), "commentable": commentable(p), "first": [a for a, _ in spans], "last": [b for _, b in spans]}

    return _columns(rows, LINES, one, patch)


def with_fix_lines(pairs: DataFrame, vuln: str, safe: str, context: int = 1) -> DataFrame:
    """Adds diff.vuln_lines and diff.safe_lines: what the change touches on either side, null if nothing differs."""
    return _columns(pairs, "vuln_lines array<int>, safe_lines array<int>", lambda a, b: {"vuln_lines": changed(a, b, context), "safe_lines": changed(b, a, context)}, vuln, safe)


def use_small_batches(spark: SparkSession) -> None:
    """Functions of whole texts get few at a time, whatever a partition holds; a lower setting is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    # read as Spark reads it, with or without a unit
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _columns(rows: DataFrame, schema: str, function, *inputs: str) -> DataFrame:
    """Adds a struct column `diff` of `schema`, computed batch by batch."""
    use_small_batches(rows.sparkSession)

    @F.pandas_udf(schema)
    def run(*series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(*values) for values in zip(*series)])

    return rows.withColumn("diff", run(*inputs))


def with_patch(rows: DataFrame, old: str = "old", new: str = "new", context: int = 3) -> DataFrame:
    """Adds diff.patch, the counts of changed lines, and whether the patch applies both ways."""

    def one(a, b):
        a, b = a or "", b or ""
        patch = make(a, b, context)
        tags = [t for _, t, _, _, _ in diff_rows(patch)]
        return {"patch": patch, "added": tags.count("+"), "removed": tags.count("-"), "touched": touched(patch), "round_trip": apply(a, patch) == b and apply(b, patch, True) == a}

    return _columns(rows, "patch string, added int, removed int, touched array<int>, round_trip boolean", one, old, new)


def complete_files(files: DataFrame) -> DataFrame:
    """files (old_content, new_content, patch): fills whichever one is missing, and a status.

    A patch that fits neither side leaves the gap null and names the error.
    """

    def one(old, new, patch):
        error = None
        try:
            if old is None and new is not None and patch is not None:
                old = apply(new, patch, True)
            elif new is None and old is not None and patch is not None:
                new = apply(old, patch)
            elif patch is None and old is not None and new is not None:
                patch = make(old, new)
        except BadPatch as e:
            error = str(e)
        status = None if error else "added" if not old and new else "removed" if old and not new else "unchanged" if old == new else "modified"
        return {"old": old, "new": new, "patch": patch, "status": status, "error": error}

    return _columns(files, "old string, new string, patch string, status string, error string", one, "old_content", "new_content", "patch")


def added_lines(patch: Column) -> Column:
    """Added new-file lines, folded in the JVM."""
    zero = F.struct(F.lit(0).alias("line"), F.lit(False).alias("inside"), F.array().cast("array<int>").alias("out"))

    def step(s, row):
        head = F.regexp_extract(row, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
        tag = F.substring(row, 1, 1)
        plus = s["inside"] & (tag == "+")
        moves = s["inside"] & (tag != "-") & (tag != "\\")
        return (
            F.when(head != "", F.struct(F.try_to_number(head, F.lit("999999999")).cast("int").alias("line"), F.lit(True).alias("inside"), s["out"].alias("out")))
            .otherwise(F.struct((s["line"] + F.when(moves, 1).otherwise(0)).alias("line"), s["inside"].alias("inside"), F.when(plus, F.array_append(s["out"], s["line"])).otherwise(s["out"]).alias("out")))
        )

    return F.aggregate(F.split(patch, "\n"), zero, step)["out"]
