"""Evaluation of findings: where they hit, what views and policies lose, costs, pairs of runs.

Null means "not scored", "not computable" or "nowhere", and is never a miss. Empty tables
give empty tables, or one row of zeros where there is no key; repeated rows count as often
as they stand there; ties are broken by the columns named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import exact
from palisade.functions import text as T
from palisade.functions.scalars import wilson

from .carry import running
from .names import fresh, top_per

TOLERANCE = 2
BOUND_STATES = ("confirmed", "rejected", "uncertain", "low_confidence", "not_verified", "review_suggested")


def near_lines(first: Column, last: Column, targets: Column, tolerance: int = TOLERANCE) -> Column:
    """Whether a span comes within `tolerance` lines of one of an array of lines."""
    return F.coalesce(F.exists(targets, lambda t: t.between(F.least(first, last) - tolerance, F.greatest(first, last) + tolerance)), F.lit(False))


def localised(findings: Column, targets: Column, expected: Column, tolerance: int = TOLERANCE) -> Column:
    """Three-valued hit of an array of findings (line, end_line, cwe) on target lines or expected weaknesses.

    True for a hit; null if there are no targets, or none hit and a finding stands nowhere.
    """
    findings = F.coalesce(findings, F.array().cast("array<struct<line:int,end_line:int,cwe:string>>"))
    by_cwe = F.exists(findings, lambda f: F.coalesce(F.array_contains(expected, T.cwe_id(f["cwe"])), F.lit(False)))
    hit = F.exists(findings, lambda f: f["line"].isNotNull() & near_lines(f["line"], F.coalesce(f["end_line"], f["line"]), targets, tolerance))
    none = F.coalesce(F.size(targets) <= 0, F.lit(True))
    return F.when(by_cwe, True).when(none, None).when(hit, True).when(F.exists(findings, lambda f: f["line"].isNull()), None).otherwise(False)


def change_anchored(findings: Column, anchors: Column, spans: Column, added: Column, tolerance: int = TOLERANCE) -> tuple[Column, Column]:
    """Whether a finding (path, line, end_line) is at a change, and in a function or file of one; null without facts.

    anchors: array of (path, line); spans: array of (path, first, last); added: array of paths.
    """
    last = lambda f: F.coalesce(f["end_line"], f["line"])
    anchor = F.exists(findings, lambda f: F.exists(anchors, lambda a: (a["path"] == f["path"]) & a["line"].between(f["line"] - tolerance, last(f) + tolerance)))
    inside = F.exists(findings, lambda f: F.exists(spans, lambda s: (s["path"] == f["path"]) & (s["first"] <= last(f)) & (f["line"] <= s["last"])) | F.array_contains(added, f["path"]))
    at = F.when(anchors.isNotNull(), F.coalesce(anchor, F.lit(False)))
    return at, F.when(anchors.isNotNull(), at | F.coalesce(inside, F.lit(False)))


def exact_rates(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """k, n, rate, and the ends of its exact interval; nulls are left out."""
    out = rows.groupBy(*by).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n"))
    low, high = exact.clopper_pearson(F.col("k"), F.col("n"))
    return out.select(*by, "k", "n", F.try_divide("k", "n").alias("rate"), low.alias("low"), high.alias("high"))


def outcomes_by(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """k, n and rate of several flags per group, as rows (…, flag, k, n, rate)."""
    counts = rows.groupBy(*by).agg(*[F.struct(F.count_if(F.col(f)).alias("k"), F.count(f).alias("n")).alias(f) for f in flags])
    long = counts.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f)["k"].alias("k"), F.col(f)["n"].alias("n")) for f in flags])).alias("x"))
    return long.select(*by, "x.*").withColumn("rate", F.try_divide("k", "n"))


def split_test(rows: DataFrame, side: str, flag: str) -> DataFrame:
    """Counts of a flag on the two sides of a boolean, and the exact p-value of their table."""
    n = lambda c: F.count_if(c)
    s, f = F.col(side), F.col(flag)
    out = rows.agg(n(s & f).alias("a"), n(s & ~f).alias("b"), n(~s & f).alias("c"), n(~s & ~f).alias("d"))
    return out.withColumn("p", exact.fisher(*(F.col(c) for c in "abcd")))


def paired_test(first: DataFrame, second: DataFrame) -> DataFrame:
    """The 2 x 2 table of two runs' (id, pred) and its exact p-value."""
    from .metrics import paired

    out = paired(first, second)
    return out.withColumn("p", exact.mcnemar(F.col("only_a"), F.col("only_b")))


def pairs_of(items: DataFrame, id_: str = "id") -> DataFrame:
    """(pair, n, vuln, safe, problem): members of `_vuln` / `_safe` ids by prefix, the n-th with the n-th; a missing side is a problem."""
    key, kind, n = fresh("pair", items), fresh("kind", items), fresh("n", items)
    rows = items.filter(F.col(id_).rlike("_(vuln|safe)$")).withColumn(key, T.pair_base(F.col(id_))).withColumn(kind, F.regexp_extract(F.col(id_), "(vuln|safe)$", 1))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(key, kind).orderBy(*[F.col(c) for c in items.columns])))
    both = rows.groupBy(F.col(key).alias("pair"), F.col(n).alias("n")).agg(F.max(F.when(F.col(kind) == "vuln", F.struct(*items.columns))).alias("vuln"), F.max(F.when(F.col(kind) == "safe", F.struct(*items.columns))).alias("safe"))
    problem = F.when(F.col("vuln").isNull(), "no vulnerable side").when(F.col("safe").isNull(), "no safe side")
    return both.withColumn("problem", problem)


def find_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with `item_id`: the equal id, else the item whose id has a hash more, if its candidates are one content.

    items (id, content); problem: `missing` or `ambiguous`.
    """
    hashed = r"^(.*)_[0-9a-f]{8}_(vuln|safe)$"
    alias = F.when(F.col("id").rlike(hashed), F.concat_ws("_", F.regexp_extract("id", hashed, 1), F.regexp_extract("id", hashed, 2)))
    by_alias = items.withColumn("_alias", alias).filter("_alias is not null").groupBy("_alias").agg(F.count_distinct(F.sha2("content", 256)).alias("_n"), F.min("id").alias("_first"))
    out = wanted.join(items.select("id", F.col("id").alias("_equal")).distinct(), "id", "left").join(by_alias, F.col("id") == F.col("_alias"), "left")
    found = F.coalesce("_equal", F.when(F.col("_n") == 1, F.col("_first")))
    problem = F.when(found.isNull(), F.when(F.col("_n") > 1, "ambiguous").otherwise("missing"))
    return out.select(*wanted.columns, found.alias("item_id"), problem.alias("problem"))


def unique_prefix(items: DataFrame, records: DataFrame) -> DataFrame:
    """items (id, prefix) with the value of the only record (prefix, value) of their prefix; null if there are several."""
    one = records.groupBy("prefix").agg(F.count("*").alias("_n"), F.max("value").alias("value")).filter("_n = 1").drop("_n")
    return items.join(one, "prefix", "left")


def losses(rows: DataFrame, by: list[str], strict: str, loose: str, id_: str) -> DataFrame:
    """n, count lost from the loose to the strict view, strict_only, and the ids lost (sorted)."""
    both = rows.filter(F.col(strict).isNotNull() & F.col(loose).isNotNull())
    lost, gained = F.col(loose) & ~F.col(strict), F.col(strict) & ~F.col(loose)
    # ids of what the strict view loses, which a report lists
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(lost).alias("lost"), F.count_if(gained).alias("strict_only"), F.array_sort(F.collect_list(F.when(lost, F.col(id_)))).alias("ids"))


def views(candidates: DataFrame, status: str = "status", deterministic: str = "deterministic") -> DataFrame:
    """One row for each view a candidate is in: report, with suggestions, verifier-bound, and all."""
    s, sure = F.col(status), F.coalesce(F.col(deterministic), F.lit(False))
    cases = [("verified", sure | (s == "confirmed")), ("verified_plus_review", sure | s.isin("confirmed", "review_suggested")), ("audit_only", sure | s.isin(*BOUND_STATES)), ("all", F.lit(True))]
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cases]), lambda x: x.isNotNull())
    return candidates.withColumn("view", F.explode(names))


def policies() -> list[tuple[str, Column]]:
    """Decision rules over (verdict, confidence, evidence), each with its name."""
    verdict, sure = F.col("verdict"), F.coalesce("confidence", F.lit(0))
    confirmed = lambda k: (verdict == "confirmed") & (sure >= k)
    eligible = lambda k: F.coalesce("evidence", F.lit(False)) & (((verdict == "uncertain") & (sure >= 4)) | ((verdict == "confirmed") & (sure < k)))
    out = [(f"confirmed>={k}", confirmed(k)) for k in (9, 8, 7, 6, 5)]
    out += [(f"confirmed>={k} + worth a look", confirmed(k) | eligible(k)) for k in (8, 7)]
    return out + [("confirmed", verdict == "confirmed"), ("confirmed or uncertain", verdict.isin("confirmed", "uncertain")), ("no verifier", F.lit(True))]


def policy_curve(records: DataFrame, candidates: DataFrame, by: list[str], rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """records (id, *by) flagged under every rule: (policy, *by, k, n, rate).

    candidates (id, verdict, confidence, evidence, deterministic) that were verifier-bound. A
    record is flagged if a candidate of its is deterministic or kept by the rule; one pass.
    """
    rules = rules or policies()
    kept = [F.bool_or(F.coalesce(F.col("deterministic"), F.lit(False)) | F.coalesce(c, F.lit(False))).alias(f"p{i}") for i, (_, c) in enumerate(rules)]
    flags = records.join(candidates.groupBy("id").agg(*kept), "id", "left")
    counts = flags.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"p{i}")).alias(f"k{i}") for i in range(len(rules))])
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"k{i}").alias("k")) for i, (name, _) in enumerate(rules)]))
    return counts.select(*by, "n", long.alias("x")).select("x.policy", *by, "x.k", "n", F.try_divide("x.k", "n").alias("rate"))


def cost_rollup(records: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean (to 3 places), p90 by nearest rank and total of each value per group, as rows (…, measure, …)."""
    long = records.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("m")).select(*by, "m.*").filter("x is not null")
    from .metrics import nearest_rank

    p90 = nearest_rank(long, [*by, "measure"], "x", {"p90": 0.9})
    sums = long.groupBy(*by, "measure").agg(F.avg("x").alias("mean"), F.sum("x").alias("total"))
    keys = [*by, "measure"]
    return sums.join(p90.select(*keys, "n", "p90"), keys).select(*keys, "n", F.round("mean", 3).alias("mean"), "p90", "total")


def counter_totals(rows: DataFrame, by: list[str], counters: str) -> DataFrame:
    """Sums of a map column's values per key and group; null maps add nothing."""
    return rows.select(*by, F.explode(counters).alias("counter", "n")).groupBy(*by, "counter").agg(F.sum("n").alias("n"))


def category_hits(matches: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """items (id, category) scored by their matches (id, category, score): predicted, hit, and whether a twin was seen."""
    kept = matches.filter(F.col("score") >= threshold)
    best = top_per(kept, ["id"], [F.desc("score"), "point_id"]).select("id", F.col("category").alias("_found"))
    out = items.join(best, "id", "left")
    return out.select(*items.columns, F.col("_found").isNotNull().alias("predicted"), F.when(F.col("_found").isNotNull(), F.col("_found") == F.col("category")).alias("category_hit"))


def scope_rates(records: DataFrame, flag: str) -> DataFrame:
    """Rate of a flag over all records (category, cwe), those without the denial-of-service family, and those in scope."""
    scope = T.scope(F.col("category"), F.col("cwe"))
    groups = F.filter(F.array(F.lit("all"), F.when(F.col("_s") != "dos", F.lit("excl_dos")), F.when(F.col("_s") == "in", F.lit("in_scope_only"))), lambda x: x.isNotNull())
    long = records.withColumn("_s", scope).withColumn("scope", F.explode(groups))
    return long.groupBy("scope").agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n")).withColumn("rate", F.try_divide("k", "n"))


def benign_rates(records: DataFrame, tpr: float, base_rates: list[float]) -> DataFrame:
    """False-positive rate per source of benign records (source, fp), its exact upper end, and precision at base rates.

    Precision at the observed rate is null where no false positive was seen.
    """
    rows = exact_rates(records.withColumn("source", T.benign_source(F.col("source"))), ["source"], "fp")
    at = lambda fpr, pi: F.try_divide(F.lit(tpr) * pi, F.lit(tpr) * pi + fpr * (1 - pi))
    out = rows.select("source", "k", "n", "rate", F.col("high").alias("upper"), F.explode(F.array(*map(F.lit, base_rates))).alias("base_rate"))
    return out.withColumn("precision", F.when(F.col("k") > 0, at(F.col("rate"), F.col("base_rate")))).withColumn("precision_upper", at(F.col("upper"), F.col("base_rate")))


def benign_provenance(benign: DataFrame, others: DataFrame) -> DataFrame:
    """benign (id, commit, files array) with what shares their commit among others (id, kind, commit, files)."""
    near = benign.filter("commit is not null").select("id", "commit", "files").join(others.select(F.col("id").alias("_other"), "kind", "commit", F.col("files").alias("_files")), "commit")
    subset = (F.col("kind") == "vuln_fix") & (F.size("files") > 0) & (F.size(F.array_except("files", "_files")) == 0)
    shared = near.groupBy("id").agg(
        F.array_sort(F.collect_set("_other")).alias("shares_commit_with"), F.bool_or(F.col("kind") == "vuln_introducing").alias("shares_commit_with_intro"),
        F.bool_or(F.col("kind") == "vuln_fix").alias("shares_commit_with_fix"), F.bool_or(subset).alias("identical_subset_of_fix_files"),
    )
    out = benign.join(shared, "id", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(*benign.columns, F.coalesce("shares_commit_with", F.array().cast("array<string>")).alias("shares_commit_with"), no("shares_commit_with_intro"), no("shares_commit_with_fix"), no("identical_subset_of_fix_files"))


def overlap(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Union, overlap and parts of two flags; rows where either is unknown are left out."""
    x, y = F.col(a), F.col(b)
    out = rows.filter(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    return out.withColumn("union_rate", F.try_divide(F.col("both") + F.col("only_a") + F.col("only_b"), F.col("n")))


def any_per_group(rows: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Rates of groups with any member flagged."""
    per = rows.groupBy(group).agg(*[F.bool_or(f).alias(f) for f in flags])
    return outcomes_by(per, [], flags)


def breakdown(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Rate of a flag per key with its Wilson interval, the largest group first (place from 1)."""
    out = rows.groupBy(key).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    out = out.withColumns({"rate": F.try_divide("k", "n"), "low": low, "high": high})
    # one row a key
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def status_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Items per kind: scored, errored with and without a part of a result, not run. records (status, calls)."""
    s, part = F.col("status"), (F.col("status") == "error") & (F.coalesce("calls", F.lit(0)) > 0)
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(s.isin("ok", "cached")).alias("scored"), F.count_if(part).alias("errored_partial"),
        F.count_if((s == "error") & ~part).alias("errored_no_result"), F.count_if(s == "not_run").alias("not_run"),
    )


def usage_totals(events: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Sums of counters over events that have any; a group without is null."""
    some = F.coalesce(*[F.col(c) for c in counters]).isNotNull()
    return events.groupBy(*by).agg(*[F.when(F.bool_or(some), F.sum(F.when(some, F.coalesce(F.col(c), F.lit(0))))).alias(c) for c in counters])


def common_views(records: DataFrame, id_: str, view: str) -> DataFrame:
    """Views that every record with findings has. records (id, view), a row for each view a record has."""
    have = records.select(id_, view).distinct()
    total = have.agg(F.count_distinct(id_).alias("_all"))
    return have.groupBy(view).agg(F.count("*").alias("n")).crossJoin(total).filter("n = _all").drop("_all")  # total is one row


def pacing(calls: DataFrame, run: str, order: str, tokens: str, sleep: float, per_minute: int, latency: float) -> DataFrame:
    """Seconds and calls per run made one after another: each waits for the tokens of the one before."""
    at, before = fresh("at", calls), fresh("before", calls)
    rows = running(calls.select(run, order, tokens), [run], [order], place=at, lags={before: F.col(tokens)})
    wait = F.when(F.col(at) > 1, F.greatest(F.lit(float(sleep)), 60.0 * F.col(before) / per_minute)).otherwise(0.0)
    return rows.groupBy(run).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(wait + latency).alias("seconds"))


def within_budget(rows: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows of each group with the running total of their costs, and whether that is within the budget."""
    out = running(rows, by, order, sums={"running_total": F.col(cost)})
    return out.withColumn("within", F.col("running_total") <= budget)


def replayed(records: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """records with stored findings, else those of the cached response of their key; `problem` where there is neither."""
    cached = top_per(responses, key, [F.desc("written")]).select(*key, F.col("findings").alias("_cached"))
    out = records.join(cached, key, "left")
    found = F.coalesce("findings", "_cached", F.when(F.coalesce("any_finding", F.lit(False)), None).otherwise(F.array().cast(records.schema["findings"].dataType)))
    problem = F.when(F.coalesce("any_finding", F.lit(False)) & F.coalesce("findings", "_cached").isNull(), "no cache entry")
    return out.withColumn("findings", found).withColumn("problem", problem).drop("_cached")


def variants(items: DataFrame, others: DataFrame, suffix: str = "_misleading") -> DataFrame:
    """items (id) with their variant's id, null where others (id) has none."""
    have = others.select(F.col("id").alias("variant_id")).distinct()
    return items.join(have, F.concat(F.col("id"), F.lit(suffix)) == F.col("variant_id"), "left")


def examples(rows: DataFrame, key: str, order: list[str], k: int = 5) -> DataFrame:
    """k rows: the first of every key, then the others, each in order."""
    turn = fresh("turn", rows)
    # rows beyond the k-th of a key are never among the first k
    few = top_per(rows, [key], order, k).withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return few.orderBy(F.when(F.col(turn) == 1, 0).otherwise(1), *order).limit(k).drop(turn)


def fix_examples(matches: DataFrame, scope: list[str], order: list[str], n: int) -> DataFrame:
    """The first match of each category with both codes, n for each scope. matches (…, category, cve_id, vulnerable_code, fixed_code)."""
    key = fresh("key", matches)
    whole = matches.filter("coalesce(fixed_code, '') <> '' and coalesce(vulnerable_code, '') <> ''").withColumn(key, F.coalesce(F.when(F.col("category") != "", F.col("category")), F.col("cve_id")))
    return top_per(top_per(whole, [*scope, key], order), scope, order, n).drop(key)
