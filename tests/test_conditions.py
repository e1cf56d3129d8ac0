"""Conditions taken apart, and the signals that guards and bounds give."""

import ast
import random

import pytest

from palisade.operators import conditions, features
from palisade.operators.code import _JS_TOKEN

DDL = "id long, old string, new string, language string"


def tokens_of(code):
    return [(m[0], code.count("\n", 0, m.start()) + 1, m.start(), m.end()) for m in _JS_TOKEN.finditer(code)]


def signals(spark, cases):
    rows = spark.createDataFrame([(i, old, new, g) for i, (g, old, new) in enumerate(cases)], DDL)
    changed = features.changes(features.features(rows, language="language"))
    out = changed.collect()
    return {i: {(r.family, r.kind, r.direction, r.n, round(r.weight, 6)) for r in out if r.id == i} for i in range(len(cases))}, {r.id: r for r in features.risk(changed).collect()}


def test_atoms_of_both_languages_agree():
    """Random conditions of names, calls and orderings, written in both languages: the same comparisons."""
    rng = random.Random(5)
    side = lambda: rng.choice(["a", "b.size", "f(a, g(b))", "n[i + 1]", "2", "a + b * 2", "(a - 1)"])

    def condition(deep):
        if not deep or rng.random() < 0.3:
            op = rng.choice(["<", ">", "<=", ">=", "==", None])
            return (f"{(x := side())} {op} {(y := side())}", f"{x} {op}{'=' * (op == '==')} {y}", [(x, op, y)] if op != "==" else []) if op else ((x := side()), x, [])
        (p, j, f), (q, k, g) = condition(deep - 1), condition(deep - 1)
        how = rng.choice(["and", "or", "not"])
        return (f"not ({p})", f"!({j})", f) if how == "not" else (f"({p}) {how} ({q})", f"({j}) {'&&' if how == 'and' else '||'} ({k})", f + g)

    for _ in range(500):
        py, js, want = condition(4)
        text = sorted(ast.unparse(ast.parse(f"{x} {op} {y}", mode="eval")) for x, op, y in want)
        assert sorted(a for a, _, _ in conditions.python_atoms(ast.parse(py, mode="eval").body)) == text
        tokens = tokens_of(js)
        got = [a for a, _, _ in conditions.javascript_atoms(tokens, 0, len(tokens), js)]
        assert sorted(ast.unparse(ast.parse(a, mode="eval")) for a in got) == text
    assert not list(conditions.javascript_atoms(tokens_of("a << 2 || b >>> c || d => e"), 0, 13, "a << 2 || b >>> c || d => e"))


def test_statements_and_callees():
    code = "log.warn(x);\nfoo(\n  a,\n  b)\nreturn 1"
    tokens = tokens_of(code)
    found = conditions.statements(tokens, 0, len(tokens))
    assert [code[tokens[a][2] : tokens[b - 1][3]] for a, b in found] == ["log.warn(x)", "foo(\n  a,\n  b)", "return 1"]
    assert [conditions.callee(tokens, *f) for f in found] == ["log.warn", "foo", ""]
    assert conditions.statements(tokens, 0, 0) == [] and conditions.writes_log("log.warn") and not conditions.writes_log("login")


BOUND = ("cond", "bounds_check", "removed", 1, 0.25)
CASES = [
    # a bound that guards nothing by itself; every one of a condition counts
    ("python", "def f(a):\n    if len(a) > 3:\n        a = cut(a)\n", "def f(a):\n    a = cut(a)\n", {BOUND}),
    ("python", "def f(a, d):\n    if len(a) > 3 and not d.depth <= 4:\n        a = cut(a)\n", "def f(a, d):\n    a = cut(a)\n", {(*BOUND[:3], 2, 0.25)}),
    ("javascript", "function f(a) {\n  if (a.length >= 3 || a.size < 2) a = cut(a);\n}\n", "function f(a) {\n  a = cut(a);\n}\n", {(*BOUND[:3], 2, 0.25)}),
    # other names, order or spaces change nothing; another operator nets out
    ("python", "def f(a, b):\n    if len(a) > 3 and b.size < 2:\n        go(a)\n", "def f(x, y):\n    if y.size < 2 and len(x) >= 3:\n        go(x)\n", set()),
    ("javascript", "function f(a) {\n  if (a.length>3) { go(a) }\n}\n", "function f(b) {\n  if (3 < b.length) {\n    go(b);\n  }\n}\n", set()),
    # no bounds: equality, other names, shifts
    ("python", "def f(a):\n    if len(a) == 3 or a.age > 3:\n        go(a)\n", "def f(a):\n    go(a)\n", set()),
    # within a guard a bound counts as the guard, and not once more
    ("python", "def f(a):\n    if len(a) > 3:\n        raise ValueError\n", "def f(a):\n    pass\n", {("block", "bounds_check", "removed", 1, 0.65)}),
    # logging may come before the end, other work may not
    ("python", "def f(role):\n    if not role:\n        log.info(role)\n        return None\n", "def f(role):\n    pass\n", {("block", "auth_check", "removed", 1, 0.6)}),
    ("python", "def f(role):\n    if not role:\n        x = make(role)\n        return None\n", "def f(role):\n    pass\n", set()),
    ("javascript", "function f(role) {\n  if (!role) {\n    console.warn(role)\n    return null\n  }\n}\n", "function f(role) {\n}\n", {("block", "auth_check", "removed", 1, 0.6)}),
    ("javascript", "function f(role) {\n  if (!role) {\n    x = make(role);\n    return null;\n  }\n}\n", "function f(role) {\n}\n", set()),
    # the other branch ends the flow
    ("python", "def f(role):\n    if role:\n        go()\n    else:\n        raise E\n", "def f(role):\n    go()\n", {("block", "auth_check", "removed", 1, 0.75)}),
    ("javascript", "function f(role) {\n  if (role) {\n    go();\n  } else {\n    throw new E();\n  }\n}\n", "function f(role) {\n  go();\n}\n", {("block", "auth_check", "removed", 1, 0.75)}),
    # an else of an outer condition is not the inner one's
    ("javascript", "function f(role) {\n  if (ok) { if (role) go() } else { throw new E() }\n}\n", "function f(role) {\n  if (ok) { go() } else { throw new E() }\n}\n", set()),
    # answers with a client error; assertions that are calls; what the function is given
    ("javascript", "function f(zeta, res) {\n  if (!zeta) { res.send(401); }\n}\n", "function f(zeta, res) {\n}\n", {("block", "auth_check", "removed", 1, 0.75)}),
    ("javascript", "function f(zeta) {\n  assert(zeta instanceof T);\n}\n", "function f(zeta) {\n}\n", {("block", "validation", "removed", 1, 0.55)}),
    ("python", "def f(zeta):\n    if not zeta:\n        raise E\n", "def f(zeta):\n    pass\n", {("block", "input_check", "removed", 1, 0.55)}),
    ("python", "def f(zeta):\n    if not other:\n        raise E\n", "def f(zeta):\n    pass\n", set()),
    # SQL in small letters is SQL where a call runs it
    ("python", "def f(c, i):\n    c.execute('select a from t where id = %s', (i,))\n", "def f(c, i):\n    c.execute(f'select a from t where id = {i}')\n", {("hazard", "sql", "weakened", 1, 0.85)}),
    ("python", "def f(c, i):\n    c.show('select a from t where id = %s', (i,))\n", "def f(c, i):\n    c.show(f'select a from t where id = {i}')\n", set()),
    ("python", "def f(", "def f(a):\n    if len(a) > 3:\n        go()\n", {("cond", "bounds_check", "added", 1, 0.25)}),
    ("javascript", "", "if (", set()),
]


@pytest.fixture(scope="module")
def both_ways(spark):
    there, _ = signals(spark, [c[:3] for c in CASES])
    back, _ = signals(spark, [(g, new, old) for g, old, new, _ in CASES])
    return there, back


def test_signals_of_conditions(both_ways):
    assert {i: c for i, c in both_ways[0].items() if c != CASES[i][3]} == {}


def test_signals_turn_with_the_sides(both_ways):
    turned = {"removed": "added", "added": "removed", "weakened": "strengthened", "strengthened": "weakened"}
    there, back = both_ways
    assert {i: {(f, k, turned[d], n, w) for f, k, d, n, w in c} for i, c in there.items()} == back


def test_two_lost_bounds_are_a_risk_and_one_is_none(spark):
    _, risk = signals(spark, [c[:3] for c in CASES[:3]])
    assert [(r.risk, r.neg, r.alert) for _, r in sorted(risk.items())] == [("none", 0.25, False), ("weakened", 0.5, False), ("weakened", 0.5, False)]


def _counted(monkeypatch, module, names):
    """How often functions of a module are called."""
    calls = []
    for name in names:
        monkeypatch.setattr(module, name, lambda code, f=getattr(module, name): calls.append(code) or f(code))
    return calls


def test_functions_that_differ_in_numbers_are_read_once(monkeypatch):
    import random

    from palisade.operators import features
    from palisade.plans.catalog import SHAPES

    rng = random.Random(4)
    frames = [("python", "def f(a, depth):\n    if len(a) > %s and not depth >= %s:\n        abort(%s)\n    g(\"%s '\" '%s', x[%s:], 1e-%s, %s.5, a%s)\n    if a.size < %s: return %s\n", "def f(a, depth):\n    if len(a) > %s or depth < %s:\n        raise E(%s)\n"),
              ("javascript", "function f(a, depth) {\n  if (a.length > %s && !(depth >= %s)) { return res.status(%s).end(); }\n}\n", "function f(a) {\n  if (a.size <= %s) total = %s;\n}\n")]
    frames += [(g, a + "# %s\n" * (g == "python"), b.replace("%s'", "%%s'")) for g, a, b in SHAPES]
    number = lambda: str(rng.choice([0, 1, 7, 403, 4030, 404, 12345, 98765, rng.randrange(10**6), rng.randrange(10**16), 10**17 + 1, "0x1f40", "1_000", "0" * 9]))

    def fill(text):
        return text if "%s'" in text or "%%" in text else text.replace("%s", "{}").format(*[number() for _ in range(text.count("%s"))]) if "{" not in text else text

    for _ in range(150):
        for language, old, new in frames:
            old, new = fill(old), fill(new)
            want = [(side, *f) for side, code in (("old", old), ("new", new)) for f in features._read(code, language)]
            assert list(features._rows(old, new, language, False)) == want
    features._read.cache_clear()
    features._read_pair.cache_clear()
    calls = _counted(monkeypatch, features, ["python_features"])
    out = [list(features._rows(f"def f(x, n):\n    if n < {i}:\n        x = {i}\n", f"def f(x, n):\n    if n <= {i}:\n        x = {i + 1}\n", "python", False)) for i in range(1000, 3000)]
    assert len(calls) == 2 and {r[4] for r in out[7]} == {"order:_ < 1007", "order:_ <= 1007"}


def test_what_differs_is_all_that_changes(spark):
    from palisade.operators import features

    old = "def f(a, b):\n    if a < 1:\n        g(a)\n    if b < 1:\n        h(b)\n    if not a.is_admin:\n        raise E\n    os.system(a)\n"
    new = "def f(a, b):\n    if b < 1:\n        g(b)\n    check(a)\n    subprocess.run(a)\n"
    rows = spark.createDataFrame([(1, old, new), (2, new, old), (3, old, old), (4, old, None), (5, None, new)], "id long, old string, new string")
    every, some = features.features(rows), features.features(rows, differing=True)
    key = lambda df: sorted((tuple(r) for r in features.changes(df).collect()), key=str)
    assert key(every) == key(some) and some.filter("id = 3").count() == 0 and every.filter("id = 3").count() > 0
