"""Operators that SQL does not express, against brute force and fixed cases, and their special rows."""

import itertools
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palisade.functions import exact, scalars
from palisade.functions import text as T
from palisade.operators import code, corpus, diffs, evaluation, features, funnel, intervals, metrics, packing, quotes, report, retrieval, sampling, sets
from palisade.plans.catalog import SHAPES
from palisade.sources import tables
from palisade.streaming import jobs


def one(spark, column, **values):
    """A column's value over one row of the given values."""
    rows = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return rows.select(column.alias("x")).first().x


# --- diffs ---------------------------------------------------------------------------

def brute_map(old, new):
    """Line of the new text for each old line that stays: the common head and tail, and what difflib keeps between."""
    import difflib
    from os.path import commonprefix

    head = len(commonprefix([old, new]))
    tail = len(commonprefix([old[head:][::-1], new[head:][::-1]]))
    pairs = [(i, i) for i in range(head)] + [(len(old) - k, len(new) - k) for k in range(1, tail + 1)]
    for i, j, n in difflib.SequenceMatcher(None, old[head : len(old) - tail], new[head : len(new) - tail], autojunk=False).get_matching_blocks():
        pairs += [(head + i + k, head + j + k) for k in range(n)]
    return {i + 1: j + 1 for i, j in pairs}


def test_hunks_without_lines_on_a_side():
    gone = "@@ -2,2 +1,0 @@\n-b\n-c"
    assert diffs.touched(gone) == [1, 2] and diffs.map_line(gone, 4) == 2 and diffs.map_line(gone, 1) == 1 and diffs.removed(gone) == [2, 3]
    came = "@@ -1,0 +2,2 @@\n+x\n+y"
    assert [diffs.map_line(came, i) for i in (1, 2, 3)] == [1, 4, 5] and diffs.added(came) == [2, 3] and diffs.commentable(came) == [2, 3]
    assert diffs.ranges(came) == [(2, 3)] and diffs.ranges(gone) == [] and diffs.ranges(gone, True) == [(1, 2)]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_lines_are_mapped_both_ways(context):
    rng = random.Random(context)
    for _ in range(80):
        old = [rng.choice("abcdef") for _ in range(rng.randrange(0, 16))]
        new = [x for x in old if rng.random() > 0.3]
        for _ in range(rng.randrange(3)):
            new.insert(rng.randrange(len(new) + 1), rng.choice("xyz"))
        patch = diffs.make("\n".join(old), "\n".join(new), context)
        kept = brute_map("\n".join(old).split("\n"), "\n".join(new).split("\n"))
        assert {i: diffs.map_line(patch, i) for i in kept} == kept
        assert {j: diffs.map_back(patch, j) for j in kept.values()} == {j: i for i, j in kept.items()}
        assert sorted(diffs.removed(patch)) == sorted(set(range(1, len("\n".join(old).split("\n")) + 1)) - set(kept))


def test_fix_lines(spark):
    assert diffs.changed("a\nb\nc", "a\nx\nc") == [2] and diffs.changed("a\nb", "a\ngap\nb") == [1, 2] and diffs.changed("a", "  a") is None
    rows = spark.createDataFrame([("a\nb", "a\nx\nb"), (None, None), ("", "q")], "v string, s string")
    assert [(r.diff.vuln_lines, r.diff.safe_lines) for r in diffs.with_fix_lines(rows, "v", "s").collect()] == [([1, 2], [2]), (None, None), (None, [1])]
    out = diffs.with_lines(spark.createDataFrame([("@@ -1,1 +1,2 @@\n a\n+b",), (None,)], "patch string")).collect()
    assert out[0].diff.added == [2] and out[0].diff.commentable == [1, 2] and out[1].diff.touched == []


# --- text --------------------------------------------------------------------------

def test_untrusted_text(spark):
    rows = [("a\u200bb", "a[U+200B]b"), ("x\x00\ty\n", "x[U+0000]\ty\n"), ("one\rtwo\r\nthree", "one[U+000D]two\r\nthree"), ("```py\n~~~~", "ˋˋˋpy\n˜˜˜˜"), ("``", "``"), ("<!-- x -->", "&lt;!-- x -->"), ("< /Untrusted_1>", "&lt;/Untrusted_1>"), (None, ""), ("", "")]
    df = spark.createDataFrame(rows, "t string, want string").select(T.neutral(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    long = "\n".join(f"line {i}" for i in range(40))
    cut = one(spark, T.neutral(F.col("t"), 100), t=(long, "string"))
    assert cut.startswith(long[:94].rsplit("\n", 1)[0][:60]) and cut.endswith("more characters not shown]") and len(cut.split("\n[...")[0]) <= 100
    assert one(spark, T.label(F.col("t")), t=("a\nb<c>{d}", "string")) == "a b‹c›_d_"
    assert one(spark, T.cleaned(F.col("t"), 10), t=(" a<!-- x -->b\u200b, and more text", "string")) == "ab, and m…"


def test_inert_markup(spark):
    cases = [("*b* <i>", "\\*b\\* &lt;i&gt;"), ("- item", "\\- item"), ("see http://a.b/c_d now", "see `http://a.b/c_d` now"), ("hi @you", "hi @\u200byou"), (None, ""), ("a\n b", "a b")]
    df = spark.createDataFrame(cases, "t string, want string").select(T.inline(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    assert one(spark, T.code_span(F.col("t")), t=("a ``b`` c", "string")) == "```a ``b`` c```" and one(spark, T.code_span(F.col("t")), t=("`x", "string")) == "`` `x ``"
    assert one(spark, T.code_block(F.col("t"), "  "), t=("a\n````\nb", "string")) == ["  `````", "  a", "  ````", "  b", "  `````"]


def test_names_of_things(spark):
    assert one(spark, T.commit_of(F.col("t")), t=("https://github.com/o/r/pull/7/commits/abcdef1234#diff", "string")).asDict() == {"owner": "o", "repo": "r", "sha": "abcdef1234"}
    assert one(spark, T.commit_of(F.col("t")), t=("https://example.org/o/r", "string")) is None
    refs = [("WEB", "https://github.com/o/r/commit/1234567"), ("FIX", "https://x.org"), ("FIX", "https://github.com/p/q/commit/7654321")]
    assert one(spark, T.fix_commit(F.col("r"), F.col("w")), r=(refs, "array<struct<type:string,url:string>>"), w=(None, "string")).repo == "q"
    assert one(spark, T.fix_commit(F.col("r"), F.col("w")), r=(refs, "array<struct<type:string,url:string>>"), w=("2024", "string")) is None
    assert one(spark, T.display_id(F.col("i"), F.col("a")), i=("GHSA-1", "string"), a=(["X", "CVE-2024-1"], "array<string>")) == "CVE-2024-1"
    assert one(spark, T.category(F.col("c")), c=(["cwe-79", "CWE-89"], "array<string>")) == "sqli" and one(spark, T.category(F.col("c")), c=(None, "array<string>")) == "other"
    assert one(spark, T.short_rule(F.col("c"), F.col("k")), c=("home.rules.py.exec.rule-x", "string"), k=(["exec.rule-x", "rule-x"], "array<string>")) == "exec.rule-x"
    assert one(spark, T.public_since(F.col("i"), F.col("c"), F.col("p")), i=("CVE-2020-1", "string"), c=(["2024-02-01T00:00:00Z"], "array<string>"), p=(["2023-05-05T1"], "array<string>")).asDict() == {"since": "2023-05-05", "source": "osv_published"}
    assert one(spark, T.public_since(F.col("i"), F.col("c"), F.col("c")), i=("CVE-2020-1", "string"), c=([], "array<string>")).asDict() == {"since": "2020-01-01", "source": "cve_id_year"}
    for text, want in (("0.85", 9), ("1", 1), ("1.0", 1), ("7.5", 8), ("99", 10), ("-3", 1), ("x", None), (None, None), ("nan", None)):
        assert one(spark, T.confidence(F.col("t")), t=(text, "string")) == want
    assert one(spark, T.verdict(F.col("t")), t=("**Confirmed.**", "string")) == "confirmed" and one(spark, T.verdict(F.col("t")), t=("maybe", "string")) is None
    assert one(spark, T.vocabulary(F.col("t")), t=(["Prevent XSS", "csrf token"], "array<string>")) == ["csrf", "xss"]
    assert one(spark, T.language_of(F.col("t")), t=("a/b.TS", "string")) == "javascript" and one(spark, T.guessed_language(F.col("t")), t=("import x\n", "string")) == "python"
    assert one(spark, T.scope(F.col("a"), F.col("b")), a=("redos", "string"), b=(None, "string")) == "dos" and one(spark, T.scope(F.col("a"), F.col("b")), a=(None, "string"), b=("CWE-208", "string")) == "timing_race"
    assert one(spark, T.error_class(F.lit(False), F.lit(False), F.col("o"), F.col("s")), o=(None, "array<string>"), s=([500, 429], "array<int>")) == "rate_limit"


# --- exact statistics -----------------------------------------------------------------

def test_exact_statistics(spark):
    rows = [(k, n) for n in (1, 2, 7, 40, 300) for k in {0, 1, n // 3, n - 1, n}]
    low, high = exact.clopper_pearson(F.col("k"), F.col("n"))
    cdf = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for r in spark.createDataFrame(rows, "k long, n long").select("k", "n", low.alias("a"), high.alias("b")).collect():
        assert r.a == 0 if r.k == 0 else cdf(r.k - 1, r.n, r.a) == pytest.approx(0.975, abs=1e-6)
        assert r.b == 1 if r.k == r.n else cdf(r.k, r.n, r.b) == pytest.approx(0.025, abs=1e-6)
    none = spark.createDataFrame([(0, 0)], "k long, n long").select(low.alias("a"), high.alias("b")).first()
    assert none.a is None and none.b is None
    tables_ = [(a, b, c, d) for a, b, c, d in itertools.product((0, 1, 4, 9), repeat=4) if a + b + c + d]
    for r in spark.createDataFrame(tables_, "a long, b long, c long, d long").withColumn("p", exact.fisher(*map(F.col, "abcd"))).collect():
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        p = lambda x: math.comb(col, x) * math.comb(n - col, row - x) / math.comb(n, row)  # noqa: B023, E731
        want = sum(p(x) for x in range(max(0, row + col - n), min(row, col) + 1) if p(x) <= p(r.a) * (1 + 1e-9))
        assert r.p == pytest.approx(min(1, want))
    assert one(spark, exact.mcnemar(F.col("b"), F.col("c")), b=(1, "long"), c=(9, "long")) == pytest.approx(2 * 11 / 1024)
    assert one(spark, exact.mcnemar(F.col("b"), F.col("c")), b=(900, "long"), c=(1100, "long")) == pytest.approx(7.7e-6, rel=0.1)


# --- quotes ------------------------------------------------------------------------------

CODE = "def f(x):\n    y = call(\n        x,\n        1,\n    )\n    if y:  # odd\n        return `z`\n    return run(x)\n"


@pytest.mark.parametrize("quote,claimed,want", [
    ("y = call(x, 1)", None, (2, 5)), ("  8 | return run(x)", None, (8, 8)), ("+    return run(x)", 8, (8, 8)), ("y = call(\n...\nreturn run(x);", None, (2, 8)), ("return run(x)  # other words", 6, (8, 8)),
    ("return 'z'", 7, (7, 7)), ("return 'z'", None, None), ("x", None, None), ("no such code here", 3, None), (None, 1, None), ("return run(x)\ndef f(x):", None, None),
])
def test_quotes_are_found_again(quote, claimed, want):
    found = quotes.locate(quote, CODE, claimed)
    assert (found and found[:2]) == want
    assert quotes.locate(quote, None, claimed) is None


def test_claims_by_unit(spark):
    units = spark.createDataFrame([(1, "a", 0, "first()\nsame_line(1)"), (1, "b", 1, "second()\nsame_line(1)"), (2, "a", 0, "else_where()")], "scan long, unit string, position int, code string")
    claims = spark.createDataFrame([(1, 1, "b", "same_line(1)", 2), (2, 1, "zzz", "same_line(1)", None), (3, 1, "a", "second()", 1), (4, 1, "a", "else_where()", None)], "id long, scan long, named string, quote string, claimed int")
    out = {r.id: (r.unit, r.first_line) for r in quotes.validated(claims, units, "scan").collect()}
    assert out == {1: ("b", 2), 2: ("a", 2), 3: ("b", 1)}
    assert quotes.validated(claims.filter("false"), units, "scan").count() == 0
    gone = quotes.removed_lines_with(spark.createDataFrame([("check( x )", "a\ncheck(x)\nb", [1, 2]), (None, None, None)], "t string, old string, gone array<int>"), "t", "old", "gone").collect()
    assert gone[0].lines == [2] and gone[1].lines == []


def test_answers_in_free_text(spark):
    answers = [
        ('{"findings": []}', {"findings": []}), ('text {"findings": [1]} then {"note": "}"}', {"findings": [1]}), ('<think>{"findings": [9]}</think>{"findings": [2]}', {"findings": [2]}),
        ('{"findings": [{"a": 1}, ', None), ("```json\n[1]\n```", None), ("nothing", None), (None, None), ('{"a": {"findings": [3]} oops}', None),
    ]
    out = quotes.with_answer(spark.createDataFrame(answers and [(i, a) for i, (a, _) in enumerate(answers)], "id int, content string"), needs="findings").orderBy("id").collect()
    assert [r.answer and json.loads(r.answer) for r in out] == [w for _, w in answers]
    assert quotes.last_answer("```json\n[1]\n```") == [1] and quotes.last_answer('draft {"a": 1} final {"a": 2}') == {"a": 2}
    rows = [('{"findings": []}', None), ('{"findings": 1}', "findings is not a list"), ("[1]", "response is not a JSON object"), ('{"need_context": ["x"]}', None), ('{"need_context": []}', "no findings list"), ("{}", "no findings list")]
    got = spark.createDataFrame(rows, "a string, want string").withColumn("p", quotes.answer_problem(F.col("a"))).collect()
    assert [(r.a, r.p) for r in got] == [(r.a, r.want) for r in got]


# --- code --------------------------------------------------------------------------------

PY = "import os\nLIMIT = 3\n\nclass A:\n    @deco\n    def m(self):\n        return helper(1)\n\ndef helper(x):\n    def inner():\n        return os.sep\n    return inner()\n\nhelper(2)\n"
JS = "const n = 1;\nfunction go(a) {\n  return a.map(x => x + 1);\n}\nclass B {\n  run(q) {\n    go(q);\n  }\n}\nconst later = async (z) => {\n  go(z);\n};\n"


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.js", JS), ("c.py", "def ("), ("d.txt", "def x(): pass"), ("e.py", None)], "path string, content string")
    return code.symbols(files).cache()


def test_symbols(found):
    rows = [(r.path, r.kind, r.qualname, r.start_line, r.end_line) for r in found.filter("kind <> 'call'").orderBy("path", "position").collect()]
    assert rows == [
        ("a.py", "variable", "LIMIT", 2, 2), ("a.py", "class", "A", 4, 7), ("a.py", "method", "A.m", 6, 7), ("a.py", "function", "helper", 9, 12), ("a.py", "function", "inner", 10, 11),
        ("b.js", "variable", "n", 1, 1), ("b.js", "function", "go", 2, 4), ("b.js", "function", "<anonymous>", 3, 3), ("b.js", "class", "B", 5, 9), ("b.js", "method", "B.run", 6, 8), ("b.js", "function", "later", 10, 12),
    ]
    calls = {(r.path, r.name, r.start_line, r.caller) for r in found.filter("kind = 'call'").collect()}
    assert {("a.py", "helper", 7, "A.m"), ("a.py", "inner", 12, "helper"), ("a.py", "helper", 14, None), ("b.js", "go", 7, "B.run"), ("b.js", "go", 11, "later"), ("b.js", "map", 3, "go")} <= calls


def test_lookups(spark, found):
    asked = spark.createDataFrame([(1, "mod.helper()", None), (2, "go", "nowhere.py"), (3, "A.m", "a.py"), (4, "none", None)], "id long, symbol string, file string")
    assert {(r.id, r.qualname) for r in code.definitions(found, asked).collect()} == {(1, "helper"), (2, "go"), (3, "A.m")}
    assert {(r.id, r.qualname) for r in code.callers(found, asked).collect()} == {(1, "A.m"), (2, "B.run"), (2, "later")}
    of = spark.createDataFrame([(1, "a.py", "A.m", 6)], "id long, path string, qualname string, start_line int")
    assert [r.qualname for r in code.callees(found, of).collect()] == ["helper"]
    changed = spark.createDataFrame([("a.py", "helper", "helper", 9)], "path string, qualname string, name string, start_line int")
    assert {r.qualname for r in code.context_definitions(found, changed).collect()} == {"A.m", "inner"}
    names = spark.createDataFrame([(1, "./src/x.py"), (2, "x.py"), (3, "y.py"), (4, None), (5, "deep/src/x.py")], "id long, name string")
    paths = spark.createDataFrame([("src/x.py",), ("a/y.py",), ("b/y.py",)], "path string")
    assert {r.id: r.path for r in code.resolve_paths(names, paths).collect()} == {1: "src/x.py", 2: "src/x.py", 3: None, 4: None, 5: "src/x.py"}


def test_plans(spark):
    files = spark.createDataFrame([(1, "a.py", PY, [7, 2]), (1, "n.py", PY, []), (2, "a.py", PY, None), (2, "d.txt", "x", [1]), (2, "i.py", "def f():\n  pass  # review-ignore\n", None), (2, "s.py", "x = 1\n", None)], "req long, path string, content string, changed_lines array<int>")
    out = {(r.req, r.path, r.function_name): r.changed_lines for r in code.plan_units(files, request="req").collect()}
    assert out == {(1, "a.py", "m"): [7], (1, "a.py", None): [2, 7], (2, "a.py", "m"): None, (2, "a.py", "helper"): None, (2, "a.py", "inner"): None, (2, "d.txt", None): [1], (2, "s.py", None): None}
    assert code.plan_units(files, most=1, request="req").filter("dropped").count() == 5
    old = spark.createDataFrame([("f", "go", "a = 1"), ("f", "two", "x"), ("f", "two", "y"), ("f", "same", "z = 1")], "file string, name string, code string")
    new = spark.createDataFrame([("f", "go", "a = 2", "python", 1, 3), ("f", "two", "q", "python", 4, 5), ("f", "same", "z  =  1 \n# c", "python", 6, 7), ("f", "far", "k", "python", 9, 9)], "file string, name string, code string, language string, start_line int, end_line int")
    hunks = spark.createDataFrame([("f", 2, 2), ("f", 6, 9)], "file string, first int, last int")
    assert [r.name for r in code.pair_functions(old, new, hunks).collect()] == ["go"]


def test_statements_and_diff_quality(spark):
    q = lambda a, b, g="python", c="other": code.diff_quality(a, b, g, c)
    assert q("x = 1  # a", "# b\nx = 1")["changed_stmt_lines"] == 0 and not q("x = 1", "x  =  1")["rename_only"]
    renamed = q("def f(a):\n    return a + 1", "def f(b):\n    return b + 1")
    assert renamed["rename_only"] and renamed["renamed"] == ["a>b"] and not renamed["security_rename"]
    assert q("h = md5(x)", "h = sha256(x)", c="weak_crypto")["security_rename"]
    mixed = q("def f(a, b):\n    return a + b", "def f(b, b):\n    return b + b")
    assert mixed["changed_stmt_lines"] > 0  # two names to one is no renaming
    assert q("f(a,\n  b,\n)", "f(a, b)")["changed_stmt_lines"] == 0 and q("a = 1", "a = 1\nb = 2")["changed_stmt_lines"] == 1
    assert q("let a = `x`; // c", "let a = 'x';", "javascript")["changed_stmt_lines"] == 0
    rows = spark.createDataFrame([('"""doc\nmore"""\nx = 1\n\n# c\ny = """a\nb"""\n', "python"), ("/* a\n b */\nlet x = 1; // y\n", "javascript"), (None, None)], "code string, language string")
    out = code.with_statements(rows).collect()
    assert [(r.n_statement_lines, r.comment_lines) for r in out] == [(2, [1, 2, 5]), (1, [1, 2]), (0, [])]
    pairs = spark.createDataFrame([("a = 1", "a = 2", "python", "other")], "vulnerable_code string, fixed_code string, language string, category string")
    assert code.with_quality(pairs).first().quality.changed_stmt_lines == 2
    lines = ["x", "@a", "@b", "def f():", "  pass"]
    assert one(spark, code.decorated_start(F.col("l"), F.lit(4)), l=(lines, "array<string>")) == 2
    assert one(spark, code.elided(F.col("l"), F.array(F.lit(0), F.lit(4)), F.lit(10)), l=(lines, "array<string>")) == "10 | x\n... | [... 3 line(s) omitted: lines 11-13 ...]\n14 |   pass"


# --- features -------------------------------------------------------------------------

def test_features_flip_with_the_sides(spark):
    rows = [(i, a, b, g) for i, (g, a, b) in enumerate(SHAPES)]
    there = {r.id: r for r in features.risk(features.changes(features.features(spark.createDataFrame(rows, "id long, old string, new string, language string"), language="language"))).collect()}
    back = {r.id: r for r in features.risk(features.changes(features.features(spark.createDataFrame([(i, b, a, g) for i, a, b, g in rows], "id long, old string, new string, language string"), language="language"))).collect()}
    assert {i: (r.neg, r.pos) for i, r in there.items()} == {i: (r.pos, r.neg) for i, r in back.items() if i != 5} | {5: (there[5].neg, there[5].pos)}
    assert there[0].alert and there[6].alert and there[7].risk == "weakened" and 2 not in there and 8 not in there


@pytest.mark.parametrize("old,new", [("def f(a):\n    x = clean(a)\n    return x\n", "def f(a):\n    y = clean(a)\n    return y\n"), ("def f(a):\n    check_a(a)\n    run(a)\n", "def f(a):\n    print('start')\n    check_a(a)\n    run(a)\n"), ("def f(a):\n    check_a(a)\n    b = 1\n    run(a)\n", "def f(a):\n    b = 1\n    check_a(a)\n    run(a)\n")])
def test_harmless_edits_have_no_label(spark, old, new):
    assert features.changes(features.features(spark.createDataFrame([(1, old, new)], "id long, old string, new string"))).count() == 0


def test_evidence_leads_and_sinks(spark):
    units = spark.createDataFrame([(1, "def f(u):\n    if not u.is_admin:\n        raise E\n", "def f(u):\n    pass\n"), (2, None, "x"), (3, "", "eval(x)"), (4, "a", None), (5, "a = 1", "a = 1")], "id long, old string, new string")
    out = {r.id: r for r in features.evidence(units).collect()}
    assert out[1].risk == "weakened" and out[1].changes and [out[i].note for i in (2, 3, 4, 5)] == ["no_old_code", "new_file", "no_new_code", None] and out[3].risk == "none"
    assert features.both_ways(units.filter("id = 1"), "old", "new").first().rev_risk == "strengthened"
    patch = "@@ -1,1 +1,9 @@\n a\n+eval(x)\n+eval(y)\n+eval(z)\n+eval(os.system(q))\n+print(1)\n+open(p)\n-eval(old)\n+os.system(c)"
    assert features.sinks(patch, "python") == [(2, "code_eval"), (3, "code_eval"), (4, "code_eval"), (5, "command_exec"), (7, "file_path"), (8, "command_exec")]
    files = features.with_sinks(spark.createDataFrame([("a.py", patch, "python"), ("b.py", None, None)], "path string, patch string, language string"))
    hits = spark.createDataFrame([("a.py", "low", False), ("b.py", "high", None)], "path string, severity string, low_confidence boolean")
    guards = spark.createDataFrame([("a.py", "weakened", True, 2)], "path string, risk string, alert boolean, n_changes long")
    got = {r.path: r for r in features.leads(files, hits, guards).collect()}
    assert (got["a.py"].n_sinks, got["a.py"].priority.alert, got["a.py"].evidence) == (6, True, False) and got["b.py"].evidence and got["b.py"].n_sinks == 0
    assert features.shape("def f(a):\n  return a  # x", "python") == "def _ ( _ ) : return _" and "secret words here" not in features.masked("x = 'some secret words here'", "python")


# --- joins of lines -------------------------------------------------------------------

def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), i, rng.choice([rng.randrange(200), rng.randrange(100_000), None])) for i in range(80)] + [(None, 900, 5)]
    spans = []
    for i in range(120):
        a = rng.randrange(100_000)
        spans.append((rng.choice("ab"), i, a if i % 3 else a % 200, (a if i % 3 else a % 200) + rng.choice([0, 3, 31, 40, 2000, 90_000])))
    p, s = spark.createDataFrame(points, "k string, point long, at long"), spark.createDataFrame(spans, "k string, pos long, a long, b long")
    inside = {pt: [x for x in spans if x[0] == k and at is not None and x[2] <= at <= x[3]] for k, pt, at in points}
    assert {(r.point, r.pos) for r in intervals.containing(p, s, "k", "at", "a", "b").collect()} == {(q, x[1]) for q, xs in inside.items() for x in xs}
    got = {r.point: r.pos for r in intervals.innermost(p, s, "k", ["point"], "at", "a", "b", "pos").collect()}
    assert got == {q: min(xs, key=lambda x: (x[3] - x[2], x[1]))[1] for q, xs in inside.items() if xs}
    near = {r.point: r.pos for r in intervals.nearest(p, s, ["k"], ["point"], "at", "a", "pos").collect()}
    assert near == {q: min((abs(at - x[2]), x[1]) for x in spans if x[0] == k)[1] for k, q, at in points if at is not None and k}
    close = {(r.point, r.pos) for r in intervals.within(p, s, ["k"], "at", "a", 50).collect()}
    assert close == {(q, x[1]) for k, q, at in points for x in spans if at is not None and x[0] == k and abs(at - x[2]) <= 50}
    hits = spark.createDataFrame([("a", 5, "x"), ("a", None, "y"), ("b", 8, "z")], "k string, l long, source string")
    f = spark.createDataFrame([("a", 1, 7), ("a", 2, 90), ("a", 3, None), ("b", 4, 12), ("c", 5, 1)], "k string, id long, line long")
    assert {r.id: r.sources for r in intervals.corroborated(f, hits, "k", "id", "line", "l", "source").collect()} == {1: "x,y", 2: "y", 3: "x,y", 4: None, 5: None}
    walls = spark.createDataFrame([("a", 10, 50)], "k string, a long, b long")
    fs = spark.createDataFrame([("a", 1, 1, 100), ("a", 2, 12, 40), ("a", 3, 15, 20)], "k string, pos long, a long, b long")
    pt = spark.createDataFrame([("a", 7, 16), ("a", 8, 70)], "k string, point long, at long")
    assert {r.point: r.pos for r in intervals.outermost_within(pt, fs, walls, "k", ["point"], "at", "a", "b", "pos").collect()} == {7: 2, 8: 1}


# --- sets, sampling, metrics ---------------------------------------------------------

def test_near_duplicates_with_hot_tokens(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(20)]
    rows = [(i, sorted({*(x for x in base if rng.random() > 0.12), *[f"r{rng.randrange(60)}" for _ in range(rng.randrange(3))]})) for i in range(70)] + [(100, base), (101, base), (102, ["a"]), (None, base)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    real = [(i, set(t)) for i, t in rows if i is not None and len(t) >= 5]
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(real), 2) if len(x & y) / len(x | y) >= 0.7}
    for cell in (2000, 7):
        assert {(r.a, r.b): r.jaccard for r in sets.near_duplicate_links(df, cell=cell).collect()} == pytest.approx(want)
    member, links = sets.near_duplicate_classes(df.filter("id is not null"))
    heads = {i: min(j for j, other in rows if j is not None and set(other) == set(t)) for i, t in rows if i is not None}
    assert {r.id: r.class_id for r in member.collect()} == heads and heads[101] < 101
    assert all(heads[r.a] == r.a and heads[r.b] == r.b for r in links.collect())
    out = sets.components(df.filter("id is not null").select("id"), links.select("a", "b"))
    assert out.count() == 73 and out.filter("id = 102").first().component == 102


def test_null_keys_are_equal(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, n int")
    assert [r.n for r in sets.multiset_minus(a, a.filter("n = 1"), ["k"], ["n"]).collect()].count(1) == 0
    assert sets.multiset_minus(a, a.filter("n < 3"), ["k"], ["n"]).collect()[0].n == 3
    out = sampling.group_holdout(a.withColumnRenamed("k", "g"), "g", 0.5, 1)
    assert out.count() == 3 and out.select("g", "held_out").distinct().count() == 2
    clash = spark.createDataFrame([("s", 1, 2, 3, 4, "high", 7, None, None, "x")], "scan string, id long, `copy` int, open int, place int, severity string, confidence int, exclusion string, verdict string, unit string")
    row = funnel.funnel(clash, "scan", ["unit"]).first()
    assert (row["copy"], row["open"], row["place"], row.status) == (2, 3, 4, "not_verified")
    assert funnel.funnel(clash.filter("false"), "scan", ["unit"]).count() == 0


def test_set_operators(spark):
    old = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "b", 3)], "g string, k string, line int")
    new = spark.createDataFrame([("g", "b", 1), ("g", "a", 9)], "g string, k string, line int")
    assert [(r.k, r.line) for r in sets.representatives(old.withColumn("n", F.lit(1)), new, ["g", "k"], ["g"], ["line"], "n").collect()] == [("a", 2)]
    maps = spark.createDataFrame([({"f": ["a"]}, {"f": ["a"], "g": ["u", "v"], "h": ["w"]}, ["h"])], "o map<string,array<string>>, n map<string,array<string>>, c array<string>")
    assert maps.select(sets.new_helpers(F.col("o"), F.col("n"), F.col("c")).alias("x")).first().x == ["u", "v"]
    units = corpus.split_units(spark.createDataFrame([(1, "A", ["B"], "r", "s"), (2, "B", None, "q", "s")], "id long, advisory string, aliases array<string>, repo string, stratum string"), spark.createDataFrame([(3, "q", "s"), (4, None, "s")], "id long, repo string, stratum string"))
    parts = sets.components(units.select("id"), corpus.key_links(units))
    assert {r.id: r.component for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    cells = corpus.cell_counts(units.join(parts, "id"), "component", "kind", ["pair", "ordinary"])
    assert {(r.component, r.pair, r.ordinary) for r in cells.collect()} == {(1, 2, 1), (4, 0, 1)}


def test_greedy_samples(spark):
    rng = random.Random(4)
    rows = [("p", g, kind, f"{g}{kind}") for g in range(40) for kind in rng.choice([["v"], ["s"], ["v", "s"]])]
    items = spark.createDataFrame(rows, "pool string, grp int, kind string, id string")
    got = sampling.atomic_by_kind(items, "pool", "grp", "kind", "id", {"v": 9, "s": 7}, 3).collect()
    assert [sum(r.kind == k for r in got) for k in "vs"] == [9, 7]
    for g in {r.grp for r in got}:
        assert sum(r.grp == g for r in got) == sum(x[1] == g for x in rows)  # whole groups
    more = sampling.balanced(items.withColumn("pos", F.col("kind") == "v"), "pool", "grp", "pos", 13, 3).collect()
    assert len(more) <= 13 and abs(sum(r.pos for r in more) * 2 - len(more)) <= 1 and len(more) >= 12
    assert sampling.preferred(items.withColumn("lm", F.col("grp") > 35), ["pool"], "lm", "id", 4, 1).filter("grp > 35").count() == 4
    repos = spark.createDataFrame([("dev", "a"), ("test", "b"), ("dev", "c"), ("zzz", "d")], "split string, repo string")
    order = {r.repo: r.place for r in sampling.ordered_repos(repos, "split", "repo", 1).collect()}
    assert {order["a"], order["c"]} == {1, 2} and order["b"] == 3 and order["d"] == 4
    pools = spark.createDataFrame([("a", 3), ("b", 0), ("c", 7)], "k string, size long")
    assert {r.k: r.quota for r in sampling.largest_remainder(pools, "k", "size", 99, capped=True).collect()} == {"a": 3, "b": 0, "c": 7}
    weighed = spark.createDataFrame([("a", 3, 1), ("b", 9, 1)], "k string, size long, w long")
    assert {r.k: r.quota for r in sampling.largest_remainder(weighed, "k", "size", 10, capped=True, weight="w").collect()} == {"a": 3, "b": 5}


def test_quantiles_of_one_hot_group(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(50), rng.uniform(0, 1e6)]) for _ in range(3000)] + [None]
    df = spark.createDataFrame([("g", None if v is None else float(v)) for v in values] + [(None, 4.0)], "g string, v double")
    out = {r.g: r for r in metrics.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p90": 0.9, "all": 1.0}).collect()}
    real = sorted(v for v in values if v is not None)
    assert (out["g"].n, out["g"].p50, out["g"].p90, out["g"]["all"]) == (3000, real[1499], real[2699], real[-1]) and out[None].p50 == 4.0
    whole = metrics.nearest_rank(df, [], "v", {"p90": 0.9}).first()
    assert whole.n == 3001 and whole.p90 == sorted([*real, 4.0])[math.ceil(0.9 * 3001) - 1]


# --- retrieval ------------------------------------------------------------------------

def test_blocks_score_as_one_matrix(spark):
    rng = random.Random(7)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    points = [(i, vec()) for i in range(60)] + [(60, None), (61, [0.0] * 6), (62, vec()[:4])]
    corpus_ = spark.createDataFrame(points, "point_id long, vector array<float>").repartition(3)
    queries = corpus_.filter("point_id % 5 = 0").withColumnRenamed("point_id", "query_id")
    one_, many = (sorted(map(tuple, retrieval.nearest_points(queries, corpus_, 4, own=False, block_bytes=b).collect())) for b in (1 << 20, 300))
    assert [(q, p) for q, p, _ in one_] == [(q, p) for q, p, _ in many] and len(one_) == 12 * 4
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))) or 1)
    stored = {r.point_id: r.vector for r in corpus_.collect()}
    want = {(q, p) for q in range(0, 60, 5) for p in sorted((p for p in stored if p != q and stored[p]), key=lambda p: (-cos(stored[q], stored[p]), p))[:4]}
    assert {(q, p) for q, p, _ in one_} == want
    assert retrieval.nearest_points(queries.filter("false"), corpus_).count() == 0 and retrieval.nearest_points(queries, corpus_.filter("false")).count() == 0


def test_sparse_terms(spark):
    import zlib

    df = spark.createDataFrame([(1, "shell_run(True) shell"), (2, None), (3, "")], "id long, text string")
    got = {(r.id, r.term): r.tf for r in retrieval.sparse_terms(df, "id", "text").collect()}
    want = {}
    for t in ("shell_run", "shell", "run", "true", "shell"):
        key = (1, zlib.crc32(t.encode()) % 2**20)
        want[key] = want.get(key, 0) + 1
    assert got == want
    assert one(spark, scalars.recency(F.col("d")), d=(180.0, "double")) == pytest.approx(0.85) and one(spark, scalars.logistic(F.col("d")), d=(-800.0, "double")) == 0
    rows = spark.createDataFrame([(1, "f", 3, "c1", None), (2, "f", 3, None, "p9"), (3, "g", 3, "c1", "p9")], "id long, file string, line int, cve string, pr string")
    known = spark.createDataFrame([("f", 3, "c1", "p0", 1), ("f", 3, "c2", "p9", 2)], "file string, line int, cve string, pr string, pos int")
    got = {r.id: r._r_pos for r in retrieval.first_at(rows, known, ["file", "line"], ["cve", "pr"], "pos").collect()}
    assert got == {1: 1, 2: 2, 3: None}


# --- packing and budgets -----------------------------------------------------------------

def test_packing_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(s, u, float(rng.randrange(4)), rng.randrange(1, 8000)) for s in range(6) for u in range(25)]
    got = {(r.scan, r.unit): (r.batch, r.reason) for r in packing.pack(spark.createDataFrame(rows, "scan long, unit long, priority double, size long"), "scan").collect()}
    for s in range(6):
        batches, want = [], {}
        for _, u, _, size in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1])):
            fits = [i for i, b in enumerate(batches) if sum(b) + size <= 6000 and len(b) < 6]
            if size > 6000:
                want[s, u] = (None, "too_large")
            elif fits or len(batches) < 6:
                if not fits:
                    batches.append([])
                    fits = [len(batches) - 1]
                batches[fits[0]].append(size)
                want[s, u] = (fits[0], None)
            else:
                want[s, u] = (None, "budget")
        assert {k: v for k, v in got.items() if k[0] == s} == want


def test_shrinking_and_chunks(spark):
    size = lambda places: 10 * len(places)
    assert packing.shrunk(5, [], size, 50) == ("whole", [0, 1, 2, 3, 4]) and packing.shrunk(100, [50], size, 60) == ("changes", [0, 48, 49, 50, 51, 52]) and packing.shrunk(100, [], size, 45) == ("ends", [0, 1, 98, 99]) and packing.shrunk(9, [], size, 5) is None
    assert packing.largest_fitting(0, 100, lambda x: x * x <= 50) == 7 and packing.largest_fitting(3, 5, lambda x: False) is None
    files = spark.createDataFrame([(1, "a", 3.0, [60]), (1, "b", 2.0, [70, 30]), (1, "c", 1.0, [90, 40, 35]), (1, "d", 0.5, [500]), (1, "e", 0.1, [50])], "scan long, path string, priority double, sizes array<int>")
    out = {r.path: (r.chunk, r.version, r.reason) for r in packing.plan_chunks(files, "scan", 100, 2).collect()}
    assert out == {"a": (0, 0, None), "b": (1, 0, None), "c": (0, 1, None), "d": (None, None, "too_large"), "e": (None, None, "budget")}
    found = spark.createDataFrame([(1, 0, 0, "x", 50), (1, 0, 1, "y", 60), (1, 0, 2, "z", 1), (1, 1, 0, "x", 50), (1, 1, 1, "w", 40), (1, 6, 0, "v", 1)], "scan long, request int, place int, definition string, cost long")
    assert [r.definition for r in packing.take_context(found, "scan", 100).collect()] == ["x", "w", "v"]
    groups = spark.createDataFrame([("p", "a", i, n) for i, n in enumerate((3, 3, 3, 5))] + [("p", "b", 9, 4)], "pool string, cell string, grp long, n long")
    chosen = packing.select_groups(groups, "pool", "cell", "grp", "n", {"a": 8, "b": 2}, 1).collect()
    assert abs(sum(r.n for r in chosen) - 10) <= 2


def test_pacing_of_calls(spark):
    rows = [("k", i, float(i), 400) for i in range(6)] + [("k", 9, 9.0, 5000), ("z", 1, 0.0, None)]
    out = {(r.key, r.id): r.start for r in jobs.paced(spark.createDataFrame(rows, "key string, id long, at double, tokens long"), "key", ["id"], "at", "tokens", 1000).collect()}
    assert [out["k", i] for i in range(6)] == [0.0, 1.0, 60.0, 61.0, 120.0, 121.0] and out["k", 9] is None and out["z", 1] == 0.0
    limited = jobs.paced(spark.createDataFrame(rows[:3], "key string, id long, at double, tokens long"), "key", ["id"], "at", "tokens", 1000, most_wait=5.0)
    assert limited.filter("id = 2").first().start is None


# --- evaluation ------------------------------------------------------------------------

def test_hits_of_findings(spark):
    schema = "f array<struct<line:int,end_line:int,cwe:string>>, t array<int>, e array<string>, want boolean"
    rows = [
        ([(10, None, None)], [12], [], True), ([(10, 11, None)], [14], [], False), ([], [3], [], False), (None, [3], [], False), ([(None, None, None)], [3], [], None), ([(50, 40, None)], [45], [], True),
        ([(1, 1, "cwe-79")], None, ["CWE-79"], True), ([(1, 1, "x")], [], ["CWE-79"], None), ([(1, 1, None)], None, None, None),
    ]
    out = spark.createDataFrame(rows, schema).withColumn("got", evaluation.localised(F.col("f"), F.col("t"), F.col("e"))).collect()
    assert [r.got for r in out] == [r.want for r in out]
    facts = spark.createDataFrame([([("a", 5, 6)], [("a", 8)], [("a", 1, 30)], ["n"]), ([("a", 25, None)], [("a", 8)], [("a", 1, 30)], ["n"]), ([("n", 1, 1)], [], [], ["n"]), ([("a", 5, 6)], None, None, None)], "f array<struct<path:string,line:int,end_line:int>>, a array<struct<path:string,line:int>>, s array<struct<path:string,first:int,last:int>>, d array<string>")
    at, inside = evaluation.change_anchored(*(F.col(c) for c in "fasd"))
    assert [(r.x, r.y) for r in facts.select(at.alias("x"), inside.alias("y")).collect()] == [(True, True), (False, True), (False, True), (None, None)]


def test_lookups_of_items(spark):
    items = spark.createDataFrame([("p_0123abcd_vuln", "c"), ("q_0123abcd_vuln", "1"), ("q_99999999_vuln", "2"), ("x", "y")], "id string, content string")
    wanted = spark.createDataFrame([("p_vuln",), ("q_vuln",), ("x",), ("none",)], "id string")
    assert {r.id: (r.item_id, r.problem) for r in evaluation.find_items(items, wanted).collect()} == {"p_vuln": ("p_0123abcd_vuln", None), "q_vuln": (None, "ambiguous"), "x": ("x", None), "none": (None, "missing")}
    records = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "prefix string, value int")
    assert {r.id: r.value for r in evaluation.unique_prefix(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, prefix string"), records).collect()} == {1: 1, 2: None, 3: None}
    vs = evaluation.variants(spark.createDataFrame([("i",), ("j",)], "id string"), spark.createDataFrame([("i_misleading",)], "id string"))
    assert {r.id: r.variant_id for r in vs.collect()} == {"i": "i_misleading", "j": None}
    recs = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", False, None), ("d", True, ["s"])], "key string, any_finding boolean, findings array<string>")
    cached = spark.createDataFrame([("a", ["old"], 1), ("a", ["new"], 2)], "key string, findings array<string>, written int")
    assert {r.key: (r.findings, r.problem) for r in evaluation.replayed(recs, cached, ["key"]).collect()} == {"a": (["new"], None), "b": (None, "no cache entry"), "c": ([], None), "d": (["s"], None)}


def test_rates_views_and_provenance(spark):
    rows = spark.createDataFrame([("redos", None, True), (None, "CWE-208", True), ("sqli", "CWE-89", False)], "category string, cwe string, hit boolean")
    assert {r.scope: (r.k, r.n) for r in evaluation.scope_rates(rows, "hit").collect()} == {"all": (2, 3), "excl_dos": (1, 2), "in_scope_only": (0, 1)}
    benign = spark.createDataFrame([("benign_commit", False)] * 20 + [(None, True), (None, False)], "source string, fp boolean")
    out = {(r.source, r.base_rate): r for r in evaluation.benign_rates(benign, 0.5, [0.01]).collect()}
    assert out["real_commit", 0.01].precision is None and out["real_commit", 0.01].upper == pytest.approx(1 - 0.025 ** (1 / 20)) and out["unknown", 0.01].precision == pytest.approx(0.005 / (0.005 + 0.5 * 0.99))
    cands = spark.createDataFrame([(1, "confirmed", None), (2, "review_suggested", None), (3, "excluded", None), (4, "excluded", True)], "id int, status string, deterministic boolean")
    assert sorted((r.id, r.view) for r in evaluation.views(cands).collect()) == sorted([(1, "verified"), (1, "verified_plus_review"), (1, "audit_only"), (1, "all"), (2, "verified_plus_review"), (2, "audit_only"), (2, "all"), (3, "all"), (4, "verified"), (4, "verified_plus_review"), (4, "audit_only"), (4, "all")])
    b = spark.createDataFrame([("b1", "c", ["x"]), ("b2", None, ["x"]), ("b3", "d", [])], "id string, commit string, files array<string>")
    o = spark.createDataFrame([("v", "vuln_fix", "c", ["x", "y"]), ("w", "vuln_introducing", "d", ["z"])], "id string, kind string, commit string, files array<string>")
    got = {r.id: (r.shares_commit_with, r.shares_commit_with_intro, r.identical_subset_of_fix_files) for r in evaluation.benign_provenance(b, o).collect()}
    assert got == {"b1": (["v"], False, True), "b2": ([], False, False), "b3": (["w"], True, False)}
    runs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, view string")
    assert [r.view for r in evaluation.common_views(runs, "id", "view").collect()] == ["a"]
    p = evaluation.paired_test(spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, pred boolean"), spark.createDataFrame([(1, False), (2, False), (4, None)], "id int, pred boolean")).first()
    assert (p.only_a, p.neither, p.missing_b, p.p) == (1, 1, 1, 1.0)
    ex = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "cat string, n int")
    assert [(r.cat, r.n) for r in evaluation.examples(ex, "cat", ["n"], 3).collect()] == [("a", 0), ("b", 9), ("a", 1)]
    usage = evaluation.usage_totals(spark.createDataFrame([("x", 1, None), ("x", 2, 5), ("y", None, None)], "g string, a long, b long"), ["g"], ["a", "b"])
    assert {r.g: (r.a, r.b) for r in usage.collect()} == {"x": (3, 5), "y": (None, None)}


# --- corpus rules, reports --------------------------------------------------------------

def test_rules_that_reject(spark):
    files = [("a.py", "modified", "p", 3, 2)]
    schema = "array<struct<filename:string,status:string,patch:string,additions:int,deletions:int>>"
    detail = lambda fs: one(spark, corpus.commit_detail(F.col("f"), 1, 10), f=(fs, schema))
    assert [detail(f) for f in (files, [], None, files * 2, [("a.py", "modified", None, 1, 1)], [("a.py", "renamed", None, 1, 1)], [("a.py", "m", "p", 9, 9)], [("tests/a.py", "m", "p", 1, 1)])] == [None, "no_code_files", "no_code_files", "too_many_files", "file_without_patch", "no_changed_lines", "too_many_changed_lines", "no_code_files"]
    listed = lambda known, parents, login, kind, message: one(spark, corpus.listed_commit(F.col("k"), F.col("p"), F.col("l"), F.col("t"), F.col("m")), k=(known, "boolean"), p=(parents, "array<string>"), l=(login, "string"), t=(kind, "string"), m=(message, "string"))
    assert [listed(True, ["a"], None, None, "x"), listed(None, ["a", "b"], None, None, "x"), listed(None, ["a"], "dep[bot]", None, "x"), listed(None, ["a"], None, None, "Fix XSS"), listed(None, ["a"], None, None, "tidy up")] == ["known_fix_commit", "merge_or_root", "bot", "security_keyword_message", None]
    pairs = spark.createDataFrame([("r", "c", f"f{i}", "n", "adv" if i < 3 else None, "a = 1", ["a = 2", "a = 3", "a = 1  # x", "a = 1"][i], "python", "other") for i in range(4)], "repo string, commit string, file_path string, function_name string, advisory_id string, vulnerable_code string, fixed_code string, language string, category string")
    out = corpus.build_outputs(code.with_quality(pairs), 0.5, 1, corpus.quality_reasons(1, 3))
    got = {r.file_path: (r.reject_reasons, r.functions_in_commit) for r in out.collect()}
    assert got == {"f0": (["broad_commit"], 4), "f1": (["broad_commit"], 4), "f2": (["comment_or_format_only", "broad_commit"], 4), "f3": (["comment_or_format_only", "broad_commit"], 4)}
    assert out.select("advisory_id", "held_out").distinct().count() == 2
    fns = spark.createDataFrame([("r", "a.py", "f", 1, 9, "x\n" * 9, "python", [(5, 5)], 9), ("r", "a.py", "g", 1, 2, "x", "python", [], 1), ("r", "a.py", "h", 1, 5, "x\n" * 5, "python", None, 2), ("r", "a.py", "i", 1, 5, "y\n" * 5, "python", None, 5), ("r", "a.py", "j", 1, 5, "z\n" * 5, "python", None, 5)], "repo string, file_path string, name string, start_line int, end_line int, code string, language string, hunks array<struct<first:int,last:int>>, n int")
    mined, bodies = spark.createDataFrame([("r", "a.py", "i")], "repo string, file_path string, name string"), spark.createDataFrame([("none",)], "body string")
    assert {r.name: r.reject_reason for r in corpus.function_reject(fns, "hunks", "n", mined, bodies).collect()} == {"f": "overlaps_fix_hunk", "g": "too_short", "h": "trivial", "i": "same_function_as_mined_pair", "j": None}
    renamed = corpus.renamed_pairs(spark.createDataFrame([("p", "a", "b", 1), ("q", "a", "c", 2), ("p", "a", "b", 3)], "prefix string, vuln_code string, safe_code string, position int"))
    assert renamed.count() == 4 and renamed.select("id").distinct().count() == 4
    dated = corpus.dates(spark.createDataFrame([("CVE-2021-5", "G", "r", "s"), ("X", "X", "r", "none")], "advisory string, alias string, repo string, sha string"), spark.createDataFrame([("G", "2022-03-01")], "alias string, date string"), spark.createDataFrame([("r", "s", "2022-02-01T1")], "repo string, sha string, date string"))
    assert {r.advisory: (r.since, r.source) for r in dated.collect()} == {"CVE-2021-5": ("2022-02-01", "fix_commit"), "X": (None, "unknown")}


def test_reports(spark):
    scans = spark.createDataFrame([(1, "complete", 2, 0, 0), (2, "partial", 3, 1, 0), (3, "failed", 1, 1, 0)], "scan long, status string, total int, not_reviewed int, partial int")
    rows = spark.createDataFrame([(1, 5, None, "low", "b <b>", "a.py", 3, None, "why", "x = 1", None), (1, 4, "guard_diff", "high", None, None, 9, "CWE-1", None, None, "y\nz")], "scan long, id int, source string, severity string, title string, file_path string, line int, cwe string, explanation string, quoted_code string, fix_snippet string")
    out = {r.scan: r.body for r in report.reports(scans, rows).collect()}
    assert out[1].split("\n") == ["## Security report", "### Review findings", "- **`LOW` b &lt;b&gt;** (`a.py:3`)", "  why", "  - Code: `x = 1`", "### Removed guards (deterministic check)", "- **`HIGH` Security finding** (`line 9`, CWE-1)", "  - Suggested fix:", "    ```", "    y", "    z", "    ```", "_2 of 2 unit(s) reviewed._"]
    assert "1 of 3 unit(s) not reviewed" in out[2] and "No security findings in the code that was reviewed." in out[2] and "No deterministic findings." in out[3]
    hits = report.kept_hits(spark.createDataFrame([("a", "HIGH"), ("regex-x", "critical"), ("b", "high"), ("c", None)], "rule_id string, severity string"), "high", ["b"])
    assert {(r.rule_id, r.low_confidence) for r in hits.collect()} == {("a", False), ("regex-x", True)}
    units = spark.createDataFrame([(1, "a", "f", 3, 0), (1, "a", None, None, 1)], "scan long, path string, name string, start_line int, position int")
    matches = spark.createDataFrame([(1, "a", "f", 3, 0.5), (1, None, None, None, 0.9), (1, "a", None, None, 0.2)], "scan long, path string, name string, line int, score double")
    none = spark.createDataFrame([], "scan long, path string, name string, line int, low_confidence boolean, risk string, alert boolean")
    got = {r.position: (r.n_matches, r.best_score) for r in report.unit_rows(units, matches, none, none).orderBy(*report.unit_priority()).collect()}
    assert got == {0: (2, 0.9), 1: (1, 0.2)}
    flat = report.flat_hits(spark.createDataFrame([("u", [(1, "r")]), ("v", [])], "unit string, hits array<struct<line:int,rule:string>>"))
    assert [(r.unit, r.line, r.rule) for r in flat.collect()] == [("u", 1, "r")]


# --- sources and stores -------------------------------------------------------------------

def test_sources(spark, tmp_path):
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        z.writestr("one.json", '{"id": 1}')
        z.writestr("two.json", "[{}, {}]")
        z.writestr("bad.json", "{")
        z.writestr("x.txt", "no")
    (tmp_path / "z" / "b.zip").write_bytes(b"no zip")
    assert tables.read_zip_json(spark, str(tmp_path / "z")).count() == 3
    assert {r.id for r in tables.zip_members(spark, str(tmp_path / "z")).collect()} == {"one", "two", "bad"}
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, data in (("a.py", b"x = 1"), ("b.txt", b"no"), ("c.js", b"\xff\xfe"), ("node_modules/d.js", b"let a")):
        (tmp_path / "src" / name).write_bytes(data)
    assert [r.content for r in tables.read_code(spark, str(tmp_path / "src")).collect()] == ["x = 1"]
    import hashlib

    key = lambda u: hashlib.sha256(u.encode()).hexdigest()
    cache = spark.createDataFrame([(key("u"), 200, "body"), (key("gone"), 404, "page")], "key string, status int, body string")
    got = {r.url: (r.body, r.offline_miss) for r in tables.responses(cache, spark.createDataFrame([("u",), ("gone",), ("new",)], "url string")).collect()}
    assert got == {"u": ("body", False), "gone": (None, False), "new": (None, True)}
    (tmp_path / "v.json").write_text('{"version": 2, "rows": [{"id": "a"}]}')
    assert tables.read_versioned(spark, str(tmp_path / "v.json"), "id:string", 2).first().id == "a"
    with pytest.raises(Exception, match="another version"):
        tables.read_versioned(spark, str(tmp_path / "v.json"), "id:string", 1).collect()
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "page int, items array<string>")
    assert [r.item for r in tables.read_pages(pages, "page", "items").collect()] == ["a", "b"]
    files = spark.createDataFrame([("a.py", "added", 5), ("b.py", "removed", 5), ("c.md", None, 5), ("d.js", None, 99)], "path string, status string, size long")
    assert [r.path for r in tables.kept_files(files, 50).collect()] == ["a.py"]
    records = spark.createDataFrame([("a", "x", "x ", 1), ("a", "x", "y", 2), ("b", " ", "y", 3), (None, "x", None, 4)], "id string, code string, fixed string, pos int")
    assert [(r.id, r.fixed) for r in tables.prepared(records, "pos").collect()] == [("a", "y")]
    assert tables.quotas_of("a=1, b=20") == {"a": 1, "b": 20} and tables.grid("0:1:0.25") == [0.0, 0.25, 0.5, 0.75, 1.0]
    with pytest.raises(ValueError):
        tables.quotas_of("a=1,a=2")


def test_store_in_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    put = jobs.upsert_buckets(path, "key", ["at"], 4)
    batch = lambda *rows: spark.createDataFrame(rows, "key string, at long, vote int")
    put(batch(*[(f"k{i}", 1, i) for i in range(20)]), 0)
    second = batch(("k3", 2, 99), ("k4", 0, 77), ("new", 1, 5))
    put(second, 1)
    put(second, 1)  # run again after a failure
    put(batch(("k5", 5, 55)), 2)
    rows = {r.key: r.vote for r in jobs.read_buckets(spark, path, "key string, at long, vote int").collect()}
    assert rows == {f"k{i}": i for i in range(20)} | {"k3": 99, "new": 5, "k5": 55}
    assert jobs.read_buckets(spark, f"file://{tmp_path}/none", "key string").count() == 0


def test_states_caches_and_slots(spark):
    rows = spark.createDataFrame([("a", "queued", 1), ("b", "running", 2), ("c", "queued", 3), ("d", "queued", 4)], "job string, state string, at int")
    assert [r.job for r in jobs.claimable(rows, "job", "state", ["at"], 2).collect()] == ["a"]
    assert {r.job: r.action for r in jobs.after_restart(rows).collect()} == {"a": "rerun", "b": "fail", "c": "rerun", "d": "rerun"}
    requests = spark.createDataFrame([("x", "aa"), ("y", "b"), ("x", "aa"), (None, "q")], "key string, text string")
    out, new = jobs.filled(requests, spark.createDataFrame([("y", 7.0)], "key string, value double"), "key", "text", lambda s: s.str.len().astype(float))
    assert sorted((r.key or "", r.value) for r in out.collect() if r.key) == [("x", 2.0), ("x", 2.0), ("y", 7.0)] and [(r.key, r.value) for r in new.collect()] == [("x", 2.0)]
    loads = spark.createDataFrame([("k", t, 1.0) for t in (0, 30, 59, 60, 3599, 3601, 3659)] + [(None, 5, 2.0), ("k", None, 9.0)], "key string, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.key, r.t): r.load for r in jobs.sliding_load(loads, "key", "ts", "v").collect()}
    assert got[("k", 59)] == 3 and got[("k", 60)] == 3 and got[("k", 3601)] == 2 and got[("k", 3659)] == 2 and got[(None, 5)] == 2.0 and len(got) == 9
    named = funnel.disambiguated(spark.createDataFrame([("f", "k", 2), ("f", "k", 1), ("g", "k", 5)], "file string, key string, n int"), ["file"], "key", ["n"])
    assert sorted((r.file, r.key, r.n) for r in named.collect()) == [("f", "k", 1), ("f", "k#2", 2), ("g", "k", 5)]
