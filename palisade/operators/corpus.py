"""Building a corpus: rules that reject, holding out groups, units of a split, matching lengths.

Rules say the first reason or all of them; a null input of a rule does not fail it. Rows
with a null group are a group like any other. Empty tables give empty tables. Repeated
rows are treated alike; where one of equals is taken, the order columns decide.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.scalars import seeded

from .funnel import all_reasons, first_reason
from .names import fresh, top_per

# --- fixed values: what a claim is excluded for ---------------------------------

DOS = (r"\b(denial of service|dos attack|resource exhaustion)\b", r"\b(exhaust|overwhelm|overload).*?(resource|memory|cpu)\b", r"\b(infinite|unbounded).*?(loop|recursion)\b")
REGEX_DOS = r"\bredos\b|\bregex|\bregular expression|\bcatastrophic backtracking"
RATE_LIMITS = (r"\b(missing|lack of|no)\s+rate\s+limit", r"\brate\s+limiting\s+(missing|required|not implemented)", r"\b(implement|add)\s+rate\s+limit", r"\bunlimited\s+(requests|calls|api)")
RESOURCES = (
    r"\b(resource|memory|file)\s+leak\s+potential", r"\bunclosed\s+(resource|file|connection)", r"\b(close|cleanup|release)\s+(resource|file|connection)",
    r"\bpotential\s+memory\s+leak", r"\b(database|thread|socket|connection)\s+leak",
)
MEMORY = (
    r"\b(buffer overflow|stack overflow|heap overflow)\b", r"\b(oob)\s+(read|write|access)\b", r"\b(out.?of.?bounds?)\b", r"\b(memory safety|memory corruption)\b",
    r"\b(use.?after.?free|double.?free|null.?pointer.?dereference)\b", r"\b(segmentation fault|segfault|memory violation)\b", r"\b(integer overflow|integer underflow)\b",
)
SSRF = (r"\b(ssrf|server\s+.?side\s+.?request\s+.?forgery)\b",)
DOS_CWES = tuple(f"CWE-{n}" for n in (400, 405, 407, 409, 674, 770, 789, 834, 835, 920, 1050))
MEMORY_CWES = tuple(f"CWE-{n}" for n in (119, 120, 121, 122, 123, 124, 125, 126, 127, 131, 190, 191, 415, 416, 476, 680, 786, 787, 788, 805, 824))
C_EXTENSIONS, DOC_EXTENSIONS, CLIENT_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp"), (".md", ".markdown", ".rst", ".txt", ".adoc"), (".html", ".htm")
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|__mocks__|spec|specs|testdata|fixtures)/|(^|/)test_[^/]*\.py$|_tests?\.(py|go)$|(^|/)conftest\.py$|\.(test|spec)\.[cm]?[jt]sx?$"
# Commit texts that may be about security.
SECURITY = (
    r"(?i)secur|vulnerab|\bvuln|\bcve\b|cve-\d|ghsa|pysec|\bcwe\b|cwe-\d|advisory|exploit|malicious|attack|\bxss\b|cross.site|csrf|ssrf|\bxxe\b|\brce\b|remote code|inject|"
    r"sanitiz|sanitis|escap|travers|\bdos\b|denial.of.service|redos|catastrophic|backtrack|prototype.pollution|__proto__|overflow|bypass|privilege|unauthori|"
    r"permission|\bauth\b|authenticat|authoriz|csp\b|content.security|leak|disclos|sensitive|secret|credential|password|token|harden|unsafe|safe_load|pickle|"
    r"deseriali|symlink|zip.?slip|open.redirect|clickjack|spoof|tamper|timing|constant.time|crypto|hmac|\bssl\b|\btls\b|certificate|sandbox|\beval\b"
)
LEAST_LINES, MOST_LINES, TRIVIAL_LINES = 3, 120, 3


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _says(text: Column, patterns: tuple[str, ...]) -> Column:
    return _no(text.rlike("(?i)" + "|".join(patterns)))


def exclusion(path: Column, title: Column, explanation: Column, cwe: Column) -> Column:
    """Why a claim is excluded without being verified, or null; the first rule that holds."""
    ext, title, cwe = T.extension(path), F.coalesce(title, F.lit("")), T.cwe_id(cwe)
    whole = F.lower(F.concat_ws(" ", title, F.coalesce(explanation, F.lit(""))))
    regex = _says(whole, (REGEX_DOS,)) | _no(cwe == "CWE-1333")
    return first_reason([
        ("finding in a documentation file", ext.isin(*DOC_EXTENSIONS)),
        ("finding in test code", _no(path.rlike(TEST_PATH))),
        ("generic DoS / resource exhaustion finding", ~regex & (_no(cwe.isin(*DOS_CWES)) | _says(title, DOS))),
        ("generic rate-limiting recommendation", _says(whole, RATE_LIMITS)),
        ("resource management finding (not a security vulnerability)", _says(whole, RESOURCES)),
        ("memory-safety finding in non-C/C++ code", ~ext.isin(*C_EXTENSIONS) & (_no(cwe.isin(*MEMORY_CWES)) | _says(title, MEMORY))),
        ("SSRF finding in client-side HTML", ext.isin(*CLIENT_EXTENSIONS) & _says(whole, SSRF)),
    ])


def _holds_any(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), for a pattern of (?i) and alternatives without groups or classes.

    The text is lower-cased once, and each alternative is looked for by what must stand there as
    it is; a matcher that tries every alternative at every character is many times slower.
    """

    def one(t: Column, alternative: str) -> Column:
        literal = max(re.split(r"\\.|.[?*+]|[^a-z0-9_ -]", alternative), key=len)
        return t.contains(literal) if literal == alternative else t.contains(literal) & t.rlike(alternative)

    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.exists(F.array(lower), lambda t: reduce(Column.__or__, [one(t, a) for a in pattern.removeprefix("(?i)").split("|")]))


def security_text(text: Column) -> Column:
    return _no(_holds_any(text, SECURITY))


def listed_commit(known: Column, parents: Column, login: Column, kind: Column, message: Column) -> Column:
    """Why a listed commit is no candidate: known (boolean), parents (array), its author, its message."""
    bot = _no(login.endswith("[bot]")) | _no(kind == "Bot")
    return first_reason([("known_fix_commit", _no(known)), ("merge_or_root", F.coalesce(F.size(parents), F.lit(0)) != 1), ("bot", bot), ("security_keyword_message", security_text(message))])


def commit_detail(files: Column, most_files: int, most_changed: int) -> Column:
    """Why a commit's files (filename, status, patch, additions, deletions) rule it out."""
    code = F.filter(F.coalesce(files, F.array().cast("array<struct<filename:string,status:string,patch:string,additions:int,deletions:int>>")), lambda f: T.language_of(f["filename"]).isNotNull() & ~T.skipped_path(f["filename"]))
    none = lambda f: F.coalesce(f["patch"], F.lit("")) == ""
    renamed = lambda f: _no(f["status"] == "renamed") & none(f)
    n = F.aggregate(F.filter(code, lambda f: ~renamed(f)), F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["additions"], F.lit(0)) + F.coalesce(f["deletions"], F.lit(0)))
    return first_reason([
        ("no_code_files", F.size(code) == 0), ("too_many_files", F.size(code) > most_files), ("file_without_patch", F.exists(code, lambda f: none(f) & ~renamed(f))),
        ("too_many_changed_lines", n > most_changed), ("no_changed_lines", n == 0),
    ])


def linked_request(requests: Column) -> Column:
    """Why a commit's linked requests (title, body, labels) rule it out; null if there are none."""
    said = F.exists(requests, lambda r: security_text(F.concat_ws(" ", r["title"], r["body"], F.array_join(r["labels"], " "))))
    return F.when(_no(said), "security_keyword_linked_pr")


def function_reject(rows: DataFrame, hunks: str, statements: str, mined: DataFrame, bodies: DataFrame, least: int = LEAST_LINES, most: int = MOST_LINES, trivial: int | None = TRIVIAL_LINES) -> DataFrame:
    """Functions (repo, file_path, name, start_line, end_line, code, language) with `reject_reason`, the first of six.

    hunks: array column of (first, last); statements: count column; mined (repo, file_path,
    name); bodies (body), hashes that are taken.
    """
    n = T.line_count(F.col("code"))
    out = rows.withColumn("_body", T.body_hash(F.col("code"), F.col("language")))
    out = out.join(mined.select("repo", "file_path", "name").distinct().withColumn("_mined", F.lit(True)), ["repo", "file_path", "name"], "left")
    out = out.join(bodies.select(F.col("body").alias("_body")).distinct().withColumn("_taken", F.lit(True)), "_body", "left")
    meets = F.exists(hunks, lambda h: (h["first"] <= F.col("end_line")) & (F.col("start_line") <= h["last"]))
    reason = first_reason([
        ("overlaps_fix_hunk", _no(meets)), ("too_short", n < least), ("too_long", n > most), *([("trivial", _no(F.col(statements) <= trivial))] if trivial is not None else []),
        ("same_function_as_mined_pair", _no(F.col("_mined"))), ("duplicate_of_eval_or_corpus_body", _no(F.col("_taken"))),
    ])
    return out.withColumn("reject_reason", reason).drop("_body", "_mined", "_taken")


def functions_per_commit(pairs: DataFrame) -> DataFrame:
    """Adds functions_in_commit: the distinct (file_path, function_name) of the pair's (repo, commit)."""
    n = pairs.groupBy(F.col("repo").alias("_repo"), F.col("commit").alias("_commit")).agg(F.count_distinct(F.struct("file_path", "function_name")).alias("functions_in_commit"))
    return pairs.join(n, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("commit").eqNullSafe(F.col("_commit"))).drop("_repo", "_commit")


def quality_reasons(least_changed: int, most_functions: int, drop_other: bool = False, keep_security_renames: bool = False) -> Column:
    """All reasons against a pair with `quality`, `functions_in_commit` and `category`, the most telling first."""
    q = F.col("quality")
    exempt = F.lit(keep_security_renames) & q["rename_only"] & q["security_rename"]
    few = (q["changed_stmt_lines"] < least_changed) & ~exempt
    return all_reasons([
        ("rename_only", few & q["rename_only"]), ("comment_or_format_only", few & ~q["rename_only"] & (q["changed_stmt_lines"] == 0)),
        ("few_changed_stmt_lines", few & ~q["rename_only"] & (q["changed_stmt_lines"] > 0)),
        ("broad_commit", F.lit(most_functions > 0) & (F.col("functions_in_commit") > most_functions)), ("other_category", F.lit(drop_other) & _no(F.col("category") == "other")),
    ])


def build_outputs(pairs: DataFrame, fraction: float, seed: int, reasons: Column, group: str = "advisory_id") -> DataFrame:
    """Pairs with held_out and reject_reasons: groups are held out before anything is rejected."""
    from .sampling import group_holdout

    out = group_holdout(functions_per_commit(pairs), group, fraction, seed)
    return out.withColumn("reject_reasons", reasons).withColumn("reject_reason", F.get("reject_reasons", F.lit(0)))


def first_pairs(pairs: DataFrame, position: str) -> DataFrame:
    """The first of the pairs that are equal in repository, file, function and code before."""
    key = fresh("key", pairs)
    keyed = pairs.withColumn(key, T.pair_key(F.col("repo"), F.col("file_path"), F.col("function_name"), F.col("vulnerable_code")))
    return top_per(keyed, [key], [position]).drop(key)


def source_commits(held: DataFrame, corpus: DataFrame) -> DataFrame:
    """Commits (repo, commit, advisory_id, ecosystem) of the held-out side that the other side has nothing to do with."""
    out = held.join(corpus.select("advisory_id").distinct(), "advisory_id", "left_anti").join(corpus.select("repo", "commit").distinct(), ["repo", "commit"], "left_anti")
    return top_per(out.select("repo", "commit", "advisory_id", "ecosystem"), ["repo", "commit"], ["ecosystem", "advisory_id"])


def renamed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (prefix, vuln_code, safe_code, position) as two rows with ids by content; equal pairs once."""
    digest = F.left(F.sha1(F.concat(F.col("vuln_code"), F.lit("\0"), F.col("safe_code"))), F.lit(8))
    base = F.when(F.col("prefix").endswith(F.concat(F.lit("_"), digest)), F.col("prefix")).otherwise(F.concat_ws("_", "prefix", digest))
    once = top_per(pairs.withColumn("base", base), ["base"], ["position"])
    sides = F.array(F.struct(F.concat("base", F.lit("_vuln")).alias("id"), F.col("vuln_code").alias("code")), F.struct(F.concat("base", F.lit("_safe")).alias("id"), F.col("safe_code").alias("code")))
    return once.select("base", F.explode(sides).alias("s")).select("base", "s.id", "s.code")


def split_units(pairs: DataFrame, ordinary: DataFrame) -> DataFrame:
    """Pair units (id, advisory, aliases, repo, stratum) and ordinary ones (id, repo, stratum) with their group keys."""
    keys = lambda adv: F.array_distinct(F.filter(F.concat(adv, F.array(F.concat(F.lit("repo:"), F.col("repo")))), lambda k: k.isNotNull()))
    named = F.transform(F.concat(F.array("advisory"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.concat(F.lit("adv:"), a))
    a = pairs.select("id", F.lit("pair").alias("kind"), "repo", "stratum", keys(named).alias("keys"))
    b = ordinary.select("id", F.lit("ordinary").alias("kind"), "repo", "stratum", keys(F.array().cast("array<string>")).alias("keys"))
    return a.unionByName(b)


def key_links(units: DataFrame) -> DataFrame:
    """Edges (a, b) from every unit to the least unit that shares one of its keys; as many as keys, whatever their size."""
    rows = units.select("id", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("b"))
    return rows.join(least, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def cell_counts(units: DataFrame, component: str, cell: str, cells: list[str]) -> DataFrame:
    """One row a component with the count of its units in each of the cells."""
    return units.groupBy(component).agg(*[F.count_if(F.col(cell) == c).alias(c) for c in cells])


def dates(pairs: DataFrame, published: DataFrame, commits: DataFrame) -> DataFrame:
    """The earliest known date of each advisory. pairs (advisory, alias, repo, sha), published (alias, date), commits (repo, sha, date)."""
    p = pairs.select("advisory", "alias").distinct().join(published, "alias").groupBy("advisory").agg(F.collect_set("date").alias("_p"))
    c = pairs.select("advisory", "repo", "sha").distinct().join(commits, ["repo", "sha"]).groupBy("advisory").agg(F.collect_set("date").alias("_c"))
    none = F.array().cast("array<string>")
    out = pairs.select("advisory").distinct().join(p, "advisory", "left").join(c, "advisory", "left")
    return out.select("advisory", T.public_since(F.col("advisory"), F.coalesce("_c", none), F.coalesce("_p", none)).alias("d")).select("advisory", "d.*")


# --- matched lengths -----------------------------------------------------------------

def quantile_edges(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """(…, edges): bins + 1 values at evenly spaced places of the sorted values, the nearest rank, halves to the even one.

    Values are counted first, so that a group is as many rows as it has values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_v")
    upto = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda q: F.bround(F.lit(q) * (F.col("_all") - 1) / bins, 0)
    picks = [F.min(F.when(F.col("_to") > at(q), F.col("_v"))).alias(f"_e{q}") for q in range(bins + 1)]
    return upto.groupBy(*by).agg(*picks).select(*by, F.array(*[F.col(f"_e{q}") for q in range(bins + 1)]).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Place of the half-open bin (e, e'] that holds a value, the first one closed; null outside."""
    upper = F.slice(edges, 2, F.size(edges) - 1)
    place = F.array_min(F.filter(F.transform(upper, lambda e, i: F.when(value <= e, i)), lambda i: i.isNotNull()))
    return F.when((value >= F.get(edges, F.lit(0))) & (value <= F.element_at(edges, -1)), place)


def length_matched(items: DataFrame, reference: DataFrame, by: str, value: str, id_: str, bins: int, seed: int) -> DataFrame:
    """Adds length_matched: per group the largest seeded subset whose shares of the reference's bins are the reference's."""
    edges = quantile_edges(reference, [by], value, bins)
    ref = reference.select(by, value).join(edges, by).withColumn("_bin", bin_of(F.col(value), F.col("edges"))).groupBy(by, "_bin").agg(F.count("*").alias("_r"))
    share = ref.filter("_bin is not null").withColumn("_share", F.col("_r") / F.sum("_r").over(Window.partitionBy(by)))
    mine = items.join(edges, by, "left").withColumn("_bin", bin_of(F.col(value), F.col("edges"))).drop("edges")
    have = mine.filter("_bin is not null").groupBy(by, "_bin").agg(F.count("*").alias("_have"))
    want = share.join(have, [by, "_bin"], "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    size = F.min(F.floor(F.col("_have") / F.col("_share"))).over(Window.partitionBy(by))
    take = want.withColumn("_take", F.least(F.bround(size * F.col("_share"), 0), F.col("_have"))).select(by, "_bin", "_take")
    order = Window.partitionBy(by, "_bin").orderBy(seeded(seed, F.col(by).cast("string"), F.col("_bin").cast("string"), F.col(id_).cast("string")), id_)
    out = mine.withColumn("_i", F.row_number().over(order)).join(take, [by, "_bin"], "left")
    return out.withColumn("length_matched", F.coalesce(F.col("_i") <= F.col("_take"), F.lit(False))).drop("_i", "_bin", "_take")
