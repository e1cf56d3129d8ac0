"""Near-duplicate links: exact against brute force, and dealt out in little room."""

import itertools
import random

import pytest

from palisade.operators import sets


def brute(rows, threshold, least=5):
    real = sorted((i, set(t)) for i, t in rows if i is not None and len(t) >= least)
    return {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(real, 2) if len(x & y) / len(x | y) >= threshold}


def near_copies(rng, n, sizes, words):
    """Sets of several sizes, each followed by copies that lack or add some tokens."""
    rows = []
    while len(rows) < n:
        base = rng.sample(words, rng.choice(sizes))
        for _ in range(rng.randrange(1, 5)):
            kept = [w for w in base if rng.random() > rng.choice([0, 0.05, 0.15])]
            rows.append((len(rows), sorted({*kept, *rng.sample(words, rng.choice([0, 1, len(base) // 6]))})))
    return rows


def shuffled(spark):
    """Bytes that all stages so far have written for other stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize(("threshold", "cell"), [(0.7, 2000), (0.5, 9), (0.9, 2000)])
def test_links_of_all_sizes(spark, threshold, cell):
    rng = random.Random(cell)
    rows = near_copies(rng, 150, [4, 5, 9, 31, 33, 140, 700], [f"w{int(i ** 1.3)}" for i in range(2000)])
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(5)
    got = {(r.a, r.b): r.jaccard for r in sets.near_duplicate_links(df, threshold, cell=cell).collect()}
    assert len(got) > 20 and got == pytest.approx(brute(rows, threshold))
    assert sets.near_duplicate_links(df.limit(0), threshold).count() == 0


def test_names_and_repeated_ids(spark):
    base = [f"t{i}" for i in range(10)]
    rows = [("b", base), ("a", base[1:]), ("a", base[1:]), ("c", base), ("c", base[:3]), (None, base), ("z", [])]
    member, links = sets.near_duplicate_classes(spark.createDataFrame(rows, "id string, tokens array<string>"))
    assert sorted((r.id or "", r.class_id, r.n) for r in member.collect()) == [("", "b", 10), ("a", "a", 9), ("a", "a", 9), ("b", "b", 10), ("c", "b", 10), ("c", "c", 3), ("z", "z", 0)]
    assert [(r.a, r.b, r.jaccard) for r in links.collect()] == [("a", "b", 0.9)]


def test_candidates_take_little_room(spark):
    """Neither the sets of all rows nor a bitmap for each token go over the shuffle."""
    rng = random.Random(1)
    words = [f"{rng.getrandbits(56):014x}" for _ in range(20000)]
    rows = near_copies(rng, 400, [60, 120, 240], words)
    rows += [(i, rng.sample(words, rng.choice([60, 120, 240]))) for i in range(len(rows), len(rows) + 3000)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    before = shuffled(spark)
    assert sets.near_duplicate_links(df).count() == 395
    assert shuffled(spark) - before < 1.5 * sum(len(w) for _, t in rows for w in t)  # five times the tokens, when each token's rows held bitmaps


def test_components_of_documents(spark):
    """The query against brute force, and what it shuffles against the documents' texts."""
    import re

    from palisade.plans import catalog

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, sorted({w for w in re.split("[ \n]+", r.text) if w})) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None]
    want = {i: i for i, _ in docs}
    copies = {(min(i, j), max(i, j)) for (i, x), (j, y) in itertools.combinations(docs, 2) if x == y}
    edges = {*brute(docs, 0.7), *copies}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    before = shuffled(spark)
    assert {r.id: r.component for r in catalog.components(spark, sf).collect()} == want
    assert len(set(want.values())) < len(want)
    assert shuffled(spark) - before < 2 * sum(len(w) for _, t in docs for w in t)
