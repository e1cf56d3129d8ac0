"""Quotes of code and answers in free text: finding them again, batch by batch.

A quote is matched without white space, as a sequence of fragments (one per quoted line,
parted further at an ellipsis) that must stand in the code in order. Results for special
rows: a null or short quote, or a null code, is found nowhere; a text without JSON has no
object; every row gives one row, and other columns are kept.
"""

from __future__ import annotations

import bisect
import html
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import fresh

# Least characters of a quote, and lines searched around a claimed line, strictly and loosely (fixed values).
LEAST_CHARS, NEAR, LOOSE = 6, 40, 3

_FENCES = str.maketrans("ˋ˜", "`~")
# What neutralising puts in or leaves out, and all white space.
_LEFT_OUT = re.compile(
    r"\[U\+[0-9A-F]{4,6}\]|[\xad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u2028\u2029]|\s+"
)
_PARTS = re.compile(r"\.\.\.|…|\n")
_NUMBERS = re.compile(r"^[^\S\n]*(?:\d+|\.\.\.)[^\S\n]*\|[^\S\n]?", re.M)
_DIFF_MARKS = re.compile(r"^[^\S\n]*\d*[^\S\n]*\|[^\S\n]?\+?|^\+", re.M)
_COMMENTS = re.compile(r"[^\S\n]+(?:#|//).*$", re.M)
_QUOTES = re.compile(r"\\*[\"'`]")
_THINK = re.compile(r"<think>.*?</think>", re.S)
_FENCE = re.compile(r"```[a-zA-Z]*\n(.*?)```", re.S)
#: In place of a line that nothing may match.
GAP = "\x00"


def match_form(text: str | None) -> str:
    """A text as quotes are compared: without white space, and as if it had not been neutralised."""
    return _LEFT_OUT.sub("", html.unescape((text or "").translate(_FENCES)))


def pattern(quote: str, lenient: bool = False, loose: bool = False) -> re.Pattern | None:
    """What the joined lines of a code must begin with to hold the quote; None for too short a quote.

    A group for each part of the quote, found as early as can be and never given up again,
    so that a search is linear. lenient: comments, semicolons and commas that end a line of
    the quote may be missing; loose: quotation marks, too. A comma before a closing bracket
    may be there or not.
    """
    text = _NUMBERS.sub("", "\n".join(quote.strip().splitlines()))
    forms = [match_form(part) for part in _PARTS.split(_COMMENTS.sub("", text) if lenient else text)]
    forms = [form.rstrip(";,") if lenient else form for form in forms]
    forms = [re.sub(r",(?=[)\]}])", "", _QUOTES.sub("", form) if loose else form) for form in forms]
    if sum(map(len, forms)) < LEAST_CHARS:
        return None
    brackets = lambda form: re.escape(form[0]) + re.sub(r"\\?([)\]}])", r",?\\\1", re.escape(form[1:]))
    return re.compile("".join(f"(?>.*?({brackets(form)}))" for form in forms if form), re.S)


def locate(quote: str | None, code: str | None, claimed: int | None = None, skipped: frozenset[int] = frozenset()) -> tuple[int, int, str] | None:
    """(first, last) line from 1, and how it was found: `near` the claimed line, in the `file`, or `loose` about the line."""
    if not quote or not code:
        return None
    lines = [GAP if i in skipped else match_form(line) for i, line in enumerate(code.splitlines())]
    readings = list(dict.fromkeys((quote, _DIFF_MARKS.sub("", "\n".join(quote.splitlines())))))
    attempts = []
    for reading in readings:
        ranges = [("near", claimed - 1 - NEAR, claimed + NEAR)] if claimed else []
        ranges.append(("file", 0, len(lines)))
        attempts += [(reading, how, low, high, lenient) for how, low, high in ranges for lenient in (False, True)]
    for reading in readings if claimed else ():
        size = max(1, sum(1 for line in reading.splitlines() if line.strip()))
        attempts += [(reading, "loose", claimed - 1 - LOOSE, claimed - 1 + LOOSE + size, lenient) for lenient in (False, True)]

    for reading, how, low, high, lenient in attempts:
        loose, low = how == "loose", max(low, 0)
        wanted = pattern(reading, lenient, loose)
        within = [_QUOTES.sub("", line) if loose else line for line in lines[low:high]]
        found = wanted and wanted.match("".join(within))
        if not found:
            continue
        ends = list(itertools.accumulate(map(len, within)))
        first, last = (low + 1 + bisect.bisect_right(ends, at) for at in (found.start(1), found.end(wanted.groups) - 1))
        if not loose or abs(first - claimed) <= LOOSE:
            return first, last, how
    return None


def with_location(rows: DataFrame, quote: str = "quote", code: str = "code", claimed: str | None = None) -> DataFrame:
    """Adds first_line, last_line and match of the quote in the row's code; null where it isn't."""

    @F.pandas_udf("first_line int, last_line int, match string")
    def run(quotes: pd.Series, codes: pd.Series, lines: pd.Series) -> pd.DataFrame:
        found = [locate(q, c, None if pd.isna(n) else int(n)) or (None, None, None) for q, c, n in zip(quotes, codes, lines)]
        return pd.DataFrame(found, columns=["first_line", "last_line", "match"]).astype({"first_line": "Int32", "last_line": "Int32"})

    at = fresh("at", rows)
    kept = [c for c in rows.columns if c not in ("first_line", "last_line", "match")]
    out = rows.withColumn(at, run(F.col(quote), F.col(code), F.col(claimed) if claimed else F.lit(None).cast("int")))
    return out.select(*kept, f"{at}.first_line", f"{at}.last_line", f"{at}.match")


def removed_lines_with(rows: DataFrame, text: str, old: str, removed: str) -> DataFrame:
    """Adds `lines`: the removed old lines (array of numbers) that hold the text, in match form."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, olds: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, o, gone in zip(texts, olds, numbers):
            form, lines = match_form(t or ""), (o or "").splitlines()
            out.append([int(n) for n in (gone if gone is not None else ()) if form and 0 < n <= len(lines) and form in match_form(lines[n - 1])])
        return pd.Series(out)

    return rows.withColumn("lines", run(F.col(text), F.col(old), F.col(removed)))


def validated(claims: DataFrame, units: DataFrame, scope: str, unit: str = "unit", named: str = "named") -> DataFrame:
    """Claims with the first unit of their scope that holds their quote: the named one, else by position; others are dropped.

    claims (id, scope, named, quote, claimed), units (scope, unit, position, code). One row
    a claim; a claim meets the units of its scope alone.
    """
    pairs = claims.join(units.withColumnRenamed("position", "_position"), scope)
    own = F.coalesce(F.col(unit) == F.col(named), F.lit(False))
    pairs = pairs.withColumn("_own", own).withColumn("_claimed", F.when(own, F.col("claimed")))
    found = with_location(pairs, "quote", "code", "_claimed").filter("first_line is not null and (match <> 'loose' or _own)")
    from .names import top_per

    strict = F.when(F.col("match") == "loose", 1).otherwise(0)
    return top_per(found, ["id"], [strict, F.desc("_own"), "_position"]).drop("_own", "_claimed", "_position", "code")


# --- JSON in free text -----------------------------------------------------------

def objects(text: str) -> list[dict]:
    """The complete top-level JSON objects of a text, in order; braces within strings do not count."""
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = read(text, at)
        except json.JSONDecodeError:
            depth, inside, escaped, end = 0, False, False, None
            for j in range(at, len(text)):
                c = text[j]
                if inside:
                    inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
                elif c == '"':
                    inside = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        end = j + 1
                        break
            # what lies inside an object that ends but can't be read is no answer; one that never ends hides nothing behind it
            at = end if end is not None else len(text)
            continue
        if isinstance(found, dict):
            out.append(found)
    return out


def last_answer(text: str | None, accepts=lambda x: True) -> object | None:
    """The whole text if it is JSON, else its last accepted object, else its last fenced block that parses."""
    if text is None:
        return None
    bare = _THINK.sub("", text)
    for whole in (text, bare.strip()):
        try:
            answer = json.loads(whole)
        except ValueError:
            continue
        return answer if accepts(answer) else None
    fenced = []
    for block in reversed(_FENCE.findall(bare)):
        try:
            fenced.append(json.loads(block.strip()))
        except ValueError:
            continue
    return next((x for x in (*reversed(objects(bare)), *fenced) if accepts(x)), None)


def with_answer(rows: DataFrame, text: str = "content", needs: str | None = None) -> DataFrame:
    """Adds `answer`, the JSON of the last answer in the text; with `needs`, of objects that have a list by that name."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        accepts = (lambda x: isinstance(x, dict) and isinstance(x.get(needs), list)) if needs else (lambda x: True)
        for batch in batches:
            found = [last_answer(x, accepts) for x in batch]
            yield pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found])

    return rows.withColumn("answer", F.pandas_udf(run, "string")(F.col(text)))


def answer_problem(answer, wanted: str = "findings", instead: str = "need_context"):
    """Why a JSON text (a column) is not the answer asked for, or null."""
    kind = lambda path: F.get_json_object(answer, path)
    value = F.try_parse_json(answer)
    whole, part, other = F.schema_of_variant(value), F.try_variant_get(value, f"$.{wanted}", "variant"), F.try_variant_get(value, f"$.{instead}", "variant")
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    some = is_list(other) & (F.coalesce(kind(f"$.{instead}[0]"), F.lit("")) != "")
    return (
        F.when(~F.coalesce(whole.startswith("OBJECT"), F.lit(False)), "response is not a JSON object").when(is_list(part), None)
        .when(part.isNotNull(), f"{wanted} is not a list").when(some, None).otherwise(f"no {wanted} list")
    )
