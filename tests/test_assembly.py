"""Versions of tables that show up whole or not at all, and the checked assembly of splits."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palisade.operators import assembly
from palisade.sources import builds

ITEM = "id string, repo string, side string, kind string, commit string, advisory string, language string, title string, sampled boolean"
COMMIT = "id string, repo string, commit string, language string, title string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_version_shows_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    one, none = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, `t.x` string"), spark.createDataFrame([], "k long")
    with pytest.raises(builds.Rejected, match="no version"):
        builds.read(spark, folder)
    assert builds.build(spark, folder, {"one": one, "none": none}, {}) == 1
    with pytest.raises(builds.Rejected, match="twice: 1 rows, such as 1"):
        builds.build(spark, folder, {"one": one.limit(2)}, {"twice": builds.repeated("one", "k")})
    got = builds.read(spark, folder)
    assert rows_of(got["one"]) == rows_of(one) and got["none"].count() == 0 and got["none"].columns == ["k"]
    # killed before its manifest: the data stand there, and readers do not see them
    one.limit(1).write.parquet(f"{folder}/data/dead/one")
    # killed while the manifest was written: a folder without a file
    (tmp_path / "b" / "manifests" / "version=2" / "_temporary").mkdir(parents=True)
    assert rows_of(builds.read(spark, folder)["one"]) == rows_of(one)
    assert builds.build(spark, folder, {"one": one.limit(1)}, {"null": builds.keys_of("one", "k", F.col("k").isNull())}) == 3
    assert builds.read(spark, folder)["one"].count() == 1 and builds.read(spark, folder, 1)["one"].count() == 3
    assert builds.sweep(spark, folder) == ["dead"] and builds.sweep(spark, folder) == []
    # a manifest of the same version from another build voids both
    spark.createDataFrame([("x", [], [])], builds.MANIFEST).write.mode("append").json(f"{folder}/manifests/version=3")
    assert builds.read(spark, folder)["one"].count() == 3


def test_digests_tell_changed_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    assert builds.digest(a) == builds.digest(a.select("t", "k").repartition(5)) and builds.digest(a) != builds.digest(a.union(a.limit(1)))
    assert builds.digest(a) != builds.digest(a.fillna("")) and builds.digest(a.limit(0)) == (0, "0-0")
    folder = f"file://{tmp_path}/c"
    builds.build(spark, folder, {"a": a}, {})
    name = builds.versions(spark, folder).first().build
    a.limit(1).write.mode("append").parquet(f"{folder}/data/{name}/a")
    with pytest.raises(builds.Rejected, match="not what the manifest"):
        builds.read(spark, folder)
    assert builds.read(spark, folder, verify=False)["a"].count() == 3


def example(spark, seed=0, repos=12):
    rng = random.Random(seed)
    items, commits = [], []
    for r in range(repos):
        side = "test" if r % 4 == 0 else "dev"
        for k in range(rng.randrange(1, 5)):
            items.append((f"i{r}-{k}", f"Org/R{r}", side, rng.choice(assembly.VULNERABLE), f"c{r}-{k}", f"A{r}-{k}", rng.choice(["py", "js"]), "fix a bound", rng.random() < 0.6))
        items.append((f"b{r}", f"org/r{r}", side, "benign", None, None, "py", None, True))
        for k in range(rng.randrange(0, 7)):
            commits.append((f"n{r}-{k}", f"ORG/r{r}", f"d{r}-{k}", rng.choice(["py", "js", "go"]), "tidy"))
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(commits, COMMIT)


@pytest.mark.parametrize("n, per_repo", [(6, 2), (15, 1), (1000, 2)])
def test_splits(spark, tmp_path, n, per_repo):
    items, commits = example(spark)
    known = spark.createDataFrame([("elsewhere",)], "commit string")
    folder = f"file://{tmp_path}/s"
    assert assembly.build(folder, items, commits, known, n, 3, per_repo) == 1
    got = {name: df.collect() for name, df in builds.read(spark, folder).items()}
    all_items, all_commits = items.collect(), commits.collect()
    side = {r.repo.lower(): r.side for r in all_items}
    pool = [c for c in all_commits if side[c.repo.lower()] == "dev"]
    vulnerable = [r for r in all_items if r.kind in assembly.VULNERABLE]
    assert {r.id for r in got["test"]} == {r.id for r in vulnerable if r.side == "test"} | {c.id for c in all_commits if side[c.repo.lower()] == "test"}
    assert {r.id for r in got["dev"] if r.kind != "benign"} == {r.id for r in vulnerable if r.side == "dev" and r.sampled}
    sample = [r for r in got["dev"] if r.kind == "benign"]
    assert len(sample) == min(n, len(pool)) and {r.id for r in sample} <= {c.id for c in pool}
    # no repository gives more than the least cap that reaches n
    sizes = Counter(c.repo.lower() for c in pool)
    cap = next(k for k in range(per_repo, 99) if sum(min(s, k) for s in sizes.values()) >= min(n, len(pool)))
    given = Counter(r.repo for r in sample)
    assert not given or max(given.values()) <= cap


def test_a_sample_follows_the_mix_and_goes_round(spark):
    pool = spark.createDataFrame([(f"{g}{r}-{k}", f"{g}{r}", g) for g in ("py", "js", "go") for r in range(10) for k in range(5)], "id string, repo string, language string")
    mix = spark.createDataFrame([("py", 3), ("js", 1)], "language string, weight long")
    out = assembly.sample_commits(pool, mix, 20, 1, 2).collect()
    assert Counter(r.language for r in out) == {"py": 15, "js": 5}
    per = defaultdict(Counter)
    for r in out:
        per[r.language][r.repo] += 1
    assert sorted(per["py"].values()) == [1] * 5 + [2] * 5 and sorted(per["js"].values()) == [1] * 5
    # py can give 20 at two a repository; the rest of its quota comes from the others
    more = Counter(r.language for r in assembly.sample_commits(pool, spark.createDataFrame([("py", 1)], "language string, weight long"), 30, 1, 2).collect())
    assert more["py"] == 20 and sum(more.values()) == 30
    own = assembly.sample_commits(pool, mix.limit(0), 30, 1, 2)
    assert set(Counter(r.language for r in own.collect()).values()) == {10}


BAD = {
    "items": [
        (("z1", "org/r1", "test", "vuln_fix", "q1", "Q1", "py", "t", True), "repositories on two sides"),
        (("i1-0", "org/r0", "test", "vuln_fix", "q2", "Q2", "py", "t", True), "id in both splits"),
        (("z2", "org/r0", "test", "vuln_fix", "q3", "A1-0", "py", "t", True), "advisory in both splits"),
        ((None, "org/r0", "test", "vuln_fix", "q4", "Q4", "py", "t", True), "test: without an id or repository"),
    ],
    "commits": [
        (("z3", "org/unknown", "q5", "py", "t"), "commits without a side"),
        (("z4", "org/r0", "c1-0", "py", "t"), "commits known for flaws"),
        (("z5", "org/r0", "q6", "py", "see cve-2024-12345"), "test: advisory in the title"),
        (("z6", "org/r4", "q7", "py", "t"), "commit repeated"),
        (("z7", "org/r4", "q7", "py", "t"), "commit repeated"),
        (("z8", "org/r4", "q8", "py", "t"), "test: id repeated"),
        (("z8", "org/r4", "q9", "py", "t"), "test: id repeated"),
    ],
}


@pytest.mark.parametrize("table", sorted(BAD))
def test_a_build_that_fails_a_check_shows_nothing(spark, tmp_path, table):
    items, commits = example(spark)
    given, folder = {"items": items.withColumn("sampled", F.lit(True)), "commits": commits}, f"file://{tmp_path}/f"
    given[table] = given[table].unionByName(spark.createDataFrame([row for row, _ in BAD[table]], ITEM if table == "items" else COMMIT))
    with pytest.raises(builds.Rejected) as told:
        assembly.build(folder, given["items"], given["commits"], spark.createDataFrame([("elsewhere",)], "commit string"), 5, 1)
    assert all(why in str(told.value) for _, why in BAD[table])
    assert builds.versions(spark, folder).isEmpty() and builds.sweep(spark, folder) == []


def test_the_split_file_is_held_against(spark, tmp_path):
    items, commits = example(spark)
    known, sides = spark.createDataFrame([], "commit string"), items.select("id", "side")
    folder = f"file://{tmp_path}/p"
    assert assembly.build(folder, items, commits, known, 5, 1, pair_sides=sides) == 1
    with pytest.raises(builds.Rejected, match="not of this side in the split file"):
        assembly.build(folder, items, commits, known, 5, 1, pair_sides=sides.withColumn("side", F.lit("dev")))
    assert builds.versions(spark, folder).count() == 1
    nothing = assembly.build(f"file://{tmp_path}/e", items.limit(0), commits.limit(0), known, 5, 1)
    assert nothing == 1 and {k: v.count() for k, v in builds.read(spark, f"file://{tmp_path}/e").items()} == {"dev": 0, "test": 0, "real": 0}
