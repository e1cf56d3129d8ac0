"""Two evaluation splits out of built items and fetched commits, and what must hold of them.

items (id, repo, side, kind, commit, advisory, language, title, sampled) are what an earlier
build holds, commits (id, repo, commit, language, title) are ordinary ones, fetched since.
The dev split has the sampled vulnerable items of its side and a sample of its side's
commits; the test split has all of both. A commit goes to the side of its repository's
items; one whose repository has none is an error. Repositories are told without regard to
case. Null ids, repositories and sides are errors too; null advisories and commits are none.
Empty tables give empty splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scalars import seeded
from palisade.operators import sampling, sets
from palisade.operators.names import top_per
from palisade.sources import builds

VULNERABLE = ("vuln_introducing", "vuln_fix")
#: An identity of an advisory in a text (fixed value).
ADVISORY = r"(?i)\b(?:CVE-\d{4}-\d+|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}|PYSEC-\d{4}-\d+)\b"
COLUMNS = ("id", "repo", "side", "kind", "commit", "advisory", "language", "title")


def least_cap(rows: DataFrame, group: str, n: int, cap: int) -> int:
    """The smallest number per group, at least `cap`, with which the groups can give n rows (or all they have)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    given = lambda k: sizes.agg(F.coalesce(F.sum(F.least("size", F.lit(k))), F.lit(0))).first()[0]
    most, total = sizes.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    low, high = max(cap, 1), max(most, cap, 1)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if given(middle) >= min(n, total) else (middle + 1, high)
    return low


def sample_commits(pool: DataFrame, mix: DataFrame, n: int, seed: int, per_repo: int = 2) -> DataFrame:
    """n rows of pool (id, repo, language, ...) in the language mix (language, weight).

    A repository offers its first `per_repo` rows in seeded order, more only if n cannot be
    reached so. In a language each repository gives one row before any gives a second; what
    a language lacks of its quota the others give, in the same order.
    """
    cap = least_cap(pool, "repo", n, per_repo)
    offered = top_per(pool, ["repo"], [seeded(seed, F.col("id").cast("string")), "id"], cap)
    mixed = offered.groupBy("language").agg(F.count("*").alias("size")).join(mix, "language", "left").fillna(0, ["weight"])
    # without any weight the pool's own mix counts
    weighed = mixed.withColumn("weight", F.when(F.sum("weight").over(Window.partitionBy()) > 0, F.col("weight")).otherwise(F.col("size")))  # one row a language
    quotas = sampling.largest_remainder(weighed, "language", "size", n, True, "weight").select("language", "quota")
    turn = F.row_number().over(Window.partitionBy("language", "repo").orderBy(seeded(seed, F.col("id").cast("string")), "id"))
    dealt = offered.withColumn("_turn", turn).withColumn("_repo", seeded(seed, F.col("language"), F.col("repo").cast("string")))
    # a language gives n rows at most, so that only its first n are placed
    first = top_per(dealt, ["language"], ["_turn", "_repo", "repo"], n)
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy("language").orderBy("_turn", "_repo", "repo"))).join(quotas, "language")
    return placed.orderBy(F.col("_place") > F.col("quota"), "_turn", "_repo", "repo", "language").limit(n).drop("_turn", "_repo", "_place", "quota")


def repo_sides(items: DataFrame) -> DataFrame:
    """(repo, side): the one side of each repository, null if it has several."""
    return sets.straddling(items.withColumn("repo", F.lower("repo")), "repo", "side").select("repo", "side")


def splits(items: DataFrame, commits: DataFrame, n: int, seed: int, per_repo: int = 2) -> dict[str, DataFrame]:
    """dev, test and real (all the commits, with their sides)."""
    plain = commits.withColumn("repo", F.lower("repo")).join(repo_sides(items), "repo", "left")
    real = plain.withColumn("kind", F.lit("benign")).withColumn("advisory", F.lit(None).cast("string")).select(*COLUMNS)
    vulnerable = items.withColumn("repo", F.lower("repo")).filter(F.col("kind").isin(*VULNERABLE))
    dev = vulnerable.filter("side = 'dev' and sampled").select(*COLUMNS)
    mix = dev.filter("kind = 'vuln_introducing'").groupBy("language").agg(F.count("*").alias("weight"))
    sample = sample_commits(real.filter("side = 'dev'"), mix, n, seed, per_repo).select(*COLUMNS)
    return {
        "dev": dev.unionByName(sample),
        "test": vulnerable.filter("side = 'test'").select(*COLUMNS).unionByName(real.filter("side = 'test'")),
        "real": real,
    }


def checks(items: DataFrame, known: DataFrame, pair_sides: DataFrame | None = None) -> dict[str, builds.Check]:
    """What must find no row before a build is committed. known (commit): commits that fix or bring in flaws; pair_sides (id, side): the split file."""
    side, title = F.col("side"), F.col("title")
    known = known.select("commit").unionByName(items.filter("commit is not null").select("commit")).distinct()
    out = {
        "repositories on two sides": lambda w: items.filter(F.col("side").isNotNull()).groupBy(F.lower("repo").alias("key")).agg(F.count_distinct("side").alias("n")).filter("n > 1"),
        "commits without a side": builds.keys_of("real", "id", side.isNull()),
        "commits known for flaws": lambda w: w["real"].join(known, "commit", "left_semi").select(F.col("id").alias("key")),
    }
    for name in ("dev", "test"):
        out[f"{name}: of another side"] = builds.keys_of(name, "id", ~side.eqNullSafe(F.lit(name)))
        out[f"{name}: advisory in the title"] = builds.keys_of(name, "id", title.rlike(ADVISORY))
        out[f"{name}: without an id or repository"] = builds.keys_of(name, F.concat_ws("/", "id", "repo"), F.col("id").isNull() | F.col("repo").isNull())
        out[f"{name}: id repeated"] = builds.repeated(name, "id")
        if pair_sides is not None:
            vulnerable = lambda w, name=name: w[name].filter(F.col("kind").isin(*VULNERABLE))
            out[f"{name}: not of this side in the split file"] = lambda w, name=name, vulnerable=vulnerable: vulnerable(w).join(pair_sides.filter(F.col("side") == name), "id", "left_anti").select(F.col("id").alias("key"))
    out["commit repeated"] = builds.repeated("real", "commit")
    for key in ("repo", "advisory", "commit", "id"):
        out[f"{key} in both splits"] = builds.shared("dev", "test", key)
    return out


def build(folder: str, items: DataFrame, commits: DataFrame, known: DataFrame, n: int, seed: int, per_repo: int = 2, pair_sides: DataFrame | None = None) -> int:
    """Builds, checks and commits the splits; gives the version that `builds.read` shows."""
    spark = items.sparkSession
    return builds.build(spark, folder, splits(items, commits, n, seed, per_repo), checks(items, known, pair_sides), {"items": items, "commits": commits})
