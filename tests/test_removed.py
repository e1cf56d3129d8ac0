"""Evidence of removed controls against a plain reading of the same texts, and the ordered merge."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import diffs, removed

WORDS = ["check(user)", "if not ok:", "raise Denied", "x = read(p)", "run(x)", "# note", "log(x)", "allow(a, b)"]


def made(seed, n=40):
    """Files of old and new lines, near copies of each other."""
    rng = random.Random(seed)
    out = []
    for scan in range(n):
        old = [f"{'  ' * rng.randrange(3)}{rng.choice(WORDS)} {rng.choice(['', scan, 'z'])}".rstrip() for _ in range(rng.randrange(5, 30))]
        new = [line for line in old if rng.random() > 0.25]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), rng.choice(WORDS))
        out.append((scan, "a.py", "\n".join(old), "\n".join(new), diffs.make("\n".join(old), "\n".join(new), 0)))
    return rng, out


def brute(candidate, changes, file, function, window):
    scan, id_, path, line, end = candidate
    _, _, old, new, patch = file
    bare = lambda x: "".join(x.split())
    removed_rows, b = [], 0
    for a, b, body in diffs.hunks(patch):
        for tag, text in body:
            if tag == "-":
                removed_rows.append((a, b, bare(text)))
            a, b = a + (tag != "+"), b + (tag != "-")
    mine = [c for c in changes if c[0] == scan]
    alert_old = {a for c in mine if c[8] and bare(c[6] or "") for a, _, t in removed_rows if bare(c[6]) in t}
    alert_new = {c[7] for c in mine if c[8] and c[7] is not None}
    target, out = diffs.map_back(patch, line), []
    for c in mine:
        if not c[3] <= line <= c[4] or c[5] not in ("removed", "weakened"):
            continue
        text, old_line, at = bare(c[6] or ""), None, c[7]
        hits = sorted((abs(a - target), a, b) for a, b, t in removed_rows if text and text in t)
        if hits:
            old_line = hits[0][1]
            at = hits[0][2] if at is None else at
        if function and c[7] is None and old_line is not None and function[2] is not None:
            inside = function[2] <= old_line <= function[3]
        elif at is not None:
            inside = function[0] <= at <= function[1] if function else line - window <= at <= (end or line) + window
        else:
            inside = False
        if not text:
            why = "no_old_code"
        elif at is None:
            why = "not_located"
        elif not inside:
            why = "other_function" if function else "too_far"
        elif text in bare(new):
            why = "moved"
        elif c[8] or old_line in alert_old or c[7] in alert_new and c[7] is not None:
            why = "alert_reported"
        else:
            why = None
        out.append((scan, id_, c[1], old_line, at, why))
    return out


def test_removal_checks_equal_brute_force(spark):
    rng, files = made(3)
    changes, candidates, functions, want = [], [], [], []
    for scan, path, old, new, _ in files:
        lines, olds = new.split("\n"), old.split("\n")
        function = None
        if rng.random() < 0.6:
            a = rng.randrange(1, len(lines) + 1)
            b = rng.randrange(a, len(lines) + 1)
            function = (a, b, *((a, min(len(olds), b + 4)) if rng.random() < 0.5 else (None, None)))
            functions.append((scan, path, *function))
        for k in range(5):
            text = rng.choice([rng.choice(olds), rng.choice(olds), "not there", "", None])
            changes.append((scan, k, path, 1, rng.randrange(3, 40), rng.choice(["removed", "weakened", "added"]), text, rng.choice([None, None, rng.randrange(1, 20)]), rng.choice([False, False, True, None])))
        for k in range(3):
            line = rng.randrange(1, len(lines) + 1)
            candidates.append((scan, k, path, line, rng.choice([None, line + 2])))
    for c in candidates:
        f = next((f[2:] for f in functions if f[0] == c[0] and f[2] <= c[3] <= f[3]), None)
        want += brute(c, changes, files[c[0]], f, 5)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = removed.removal_checks(
        df(candidates, "scan int, id int, path string, line int, end_line int"), df(changes, "scan int, change int, path string, start_line int, end_line int, direction string, old_text string, line int, alert boolean"),
        df(files, "scan int, path string, old string, new string, patch string"), df(functions, "scan int, path string, start_line int, end_line int, old_start int, old_end int"), window=5,
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[5] for w in want} == {None, "no_old_code", "not_located", "other_function", "too_far", "moved", "alert_reported"}


def test_quoted_controls(spark):
    old = "def f(u, p):\n    if not u.admin:\n        raise Denied(u)\n    # a note here\n    kept_line(u, p)\n    return open(p)\n"
    new = "def f(u, p):\n    kept_line(u, p)\n    return open(p)\n"
    files = spark.createDataFrame([(1, "a", old, new, diffs.make(old, new)), (2, "a", old, old, "")], "scan int, path string, old string, new string, patch string")
    cases = {
        1: "if not u.admin:\n    raise Denied(u)", 2: "-    if not u.admin:\n-        raise Denied(u)", 3: "kept_line(u, p)", 4: "# a note here", 5: "raise Denied(u)", 6: "nowhere(1, 2)", 7: None, 8: "raise Denied(u)\n" * 13,
    }
    candidates = spark.createDataFrame([(1, i, "a", 3, q) for i, q in cases.items()] + [(2, 9, "a", 6, cases[1]), (3, 10, "a", 1, cases[1])], "scan int, id int, path string, line int, quote string")
    lines = lambda *rows: spark.createDataFrame(list(rows), "scan int, path string, line int")
    got = removed.quoted_controls(candidates, files, lines((1, "a", 2), (1, "a", 5), (2, "a", 2)), lines((1, "a", 4)), lines((9, "a", 9))).collect()
    control = "    if not u.admin:\n        raise Denied(u)"
    assert {(r.scan, r.id): (r.first_line, r.last_line, r.text) for r in got} == {(1, 1): (2, 3, control), (1, 2): (2, 3, control)}
    assert removed.quoted_controls(candidates, files, lines((1, "a", 2)), lines((1, "a", 4)), lines((1, "a", 3))).count() == 0  # told of


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_in_order(spark, seed):
    rng = random.Random(seed)
    old = [(rng.choice("ab"), i, rng.randrange(3)) for i in range(30)]
    new = [(rng.choice("abc"), i, rng.randrange(3)) for i in range(25)]
    want = []
    for g in "abc":
        waiting = [x for x in new if x[0] == g]
        for row in (x for x in old if x[0] == g):
            want.append((g, row[1], waiting.pop(0)[1] if waiting and waiting[0][2] == row[2] else None))
        want += [(g, None, x[1]) for x in waiting]
    a, b = (spark.createDataFrame(x, "file string, id long, kind int").withColumn("at", F.col("id")) for x in (old, new))
    got = removed.merged_in_order(a, b, ["file"], "at", "id", lambda x, y: x.kind == y.kind)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert removed.merged_in_order(a.filter("false"), b.filter("false"), ["file"], "at", "id", lambda x, y: True).count() == 0


def test_texts_come_to_python_few_at_a_time(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from palisade.operators import diffs, removed

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = F.pandas_udf(lambda s: pd.Series([s.str.len().sum()] * len(s)), "long")
    texts = spark.range(0, 400, 1, 1).select("id", F.concat(F.repeat(F.lit("x"), 100_000), F.col("id")).alias("text"))
    for use in (lambda: diffs.with_patch(texts, "text", "text"), lambda: removed.diff_rows(texts.selectExpr("id AS scan", "'a' AS path", "text AS patch"))):
        spark.conf.unset(name)
        use()
        assert texts.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 8_000_000
    spark.conf.set(name, "1m")
    diffs.with_patch(texts, "text", "text")
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_moved_to_another_file(spark):
    old, other = "a(x)\ncheck(user)\nrun(x)\n", "b()\nif check( user ):\n"
    files = [(1, "a", old, "a(x)\nrun(x)\n"), (1, "b", "b()\n", other), (2, "a", old, "a(x)\nrun(x)\n"), (2, "b", "b()\n", "b()\nrun()\n")]
    files = spark.createDataFrame([(s, p, o, n, diffs.make(o, n)) for s, p, o, n in files], "scan int, path string, old string, new string, patch string")
    changes = spark.createDataFrame([(s, 1, "a", 1, 9, "removed", "check(user)", None, False) for s in (1, 2)], "scan int, change int, path string, start_line int, end_line int, direction string, old_text string, line int, alert boolean")
    candidates = spark.createDataFrame([(s, 7, "a", 2, None) for s in (1, 2)], "scan int, id int, path string, line int, end_line int")
    nowhere = spark.createDataFrame([], "scan int, path string, start_line int, end_line int, old_start int, old_end int")
    got = removed.removal_checks(candidates, changes, files, nowhere)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 1, 2, 2, "moved"), (2, 7, 1, 2, 2, None)]


def test_texts_are_dealt_out_once(spark, tmp_path):
    """Old texts, removed lines and new files go over the shuffle once each; what follows are numbers and digests."""
    from test_similar import shuffled

    rng, files, changes = random.Random(5), [], []
    for scan in range(300):
        old = [f"{rng.getrandbits(800):x}" for _ in range(20)]
        new = [x if rng.random() > 0.5 else f"{rng.getrandbits(800):x}" for x in old]
        files.append((scan, "a", "\n".join(new), diffs.make("\n".join(old), "\n".join(new))))
        changes += [(scan, k, "a", 1, 99, "removed", x, None, k % 2 == 0) for k, x in enumerate(old) if x not in new]
    spark.createDataFrame(files, "scan int, path string, new string, patch string").write.parquet(f"{tmp_path}/files")
    spark.createDataFrame(changes, "scan int, change int, path string, start_line int, end_line int, direction string, old_text string, line int, alert boolean").write.parquet(f"{tmp_path}/changes")
    candidates = spark.createDataFrame([(scan, 0, "a", 5, None) for scan in range(300)], "scan int, id int, path string, line int, end_line int")
    nowhere = spark.createDataFrame([], "scan int, path string, start_line int, end_line int, old_start int, old_end int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = removed.removal_checks(candidates, spark.read.parquet(f"{tmp_path}/changes"), spark.read.parquet(f"{tmp_path}/files"), nowhere)
        assert got.count() == len(changes) and got.filter("reason is null").count() == sum(not c[8] for c in changes)
        dealt = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt < 2.5 * (sum(len(f[2]) for f in files) + sum(len(c[6]) for c in changes))
