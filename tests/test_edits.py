"""Edits that keep the meaning: what they write, that they do keep it, and that no signal sees them."""

import random

import pytest

from palisade.operators import edits

PY = {
    # a name in its scope, in inner ones that read it, and not as a field, a keyword or in a text
    "def f(a):\n    b = a\n    g = lambda: b\n    return g(b=b).b, 'b'\n": "def f(a):\n    b_renamed = a\n    g = lambda: b_renamed\n    return g(b=b_renamed).b, 'b'\n",
    # bound again within, given, global, imported: another one or none
    "def f(a):\n    b = a\n    c = [b for b in a]\n    return c\n": "def f(a):\n    b = a\n    c_renamed = [b for b in a]\n    return c_renamed\n",
    "def f(a):\n    a = 1\n    return a\n": None,
    "def f():\n    global x\n    x = 1\n": None,
    "def f():\n    x = 1\n    return locals()\n": None,
    "def f():\n    x = 1\n    x_renamed = 2\n    return x\n": "def f():\n    x_renamed_ = 1\n    x_renamed = 2\n    return x_renamed_\n",
    "def f():\n    ä = 'é'; x = ä\n    return x\n": "def f():\n    ä_renamed = 'é'; x = ä_renamed\n    return x\n",
    "def f(": None,
    "x = 1\n": None,
}
ORDER = {
    "def f(a):\n    b = 1\n    c = 2\n    return b, c\n": "def f(a):\n    c = 2\n    b = 1\n    return b, c\n",
    "def f(a):\n    b = a\n    c = b\n": None,
    "def f(a):\n    b = g(a)\n    c = h(a)\n": None,
    "def f(a):\n    b = g(a)\n    c = a\n": "def f(a):\n    c = a\n    b = g(a)\n",
    "def f(a):\n    b = g(a)\n    c = LIMIT\n": None,
    "def f(a):\n    b = 1; c = 2\n": None,
    "def f(a):\n    b = 1\n\n    c = 2\n": None,
}
JS = {
    "function f(a) {\n  const b = a;\n  return b + a.b;\n}\n": "function f(a) {\n  const b_renamed = a;\n  return b_renamed + a.b;\n}\n",
    "function f(a) {\n  const b = a;\n  return {b, c: 1};\n}\n": None,
    "function f(a) {\n  let b = a;\n  return `${b}`;\n}\n": None,
    "function f(a) {\n  let b = a;\n  { let b = 2; }\n}\n": None,
    "const b = 1;\n": None,
}


def test_renaming_and_order():
    assert {c: edits.python_rename(c) for c in PY} == PY
    assert {c: edits.python_reorder(c) for c in ORDER} == ORDER
    assert {c: edits.javascript_rename(c) for c in JS} == JS
    assert edits.javascript_reorder("function f() {\n  const a = 1;\n  let b = 'x';\n  g(a, b);\n}\n") == "function f() {\n  let b = 'x';\n  const a = 1;\n  g(a, b);\n}\n"
    assert edits.javascript_reorder("function f() {\n  const a = 1;\n  const b = a;\n}\n") is None


def test_logging():
    assert edits.python_log('def f(a):\n    """Doc."""\n    return a\n') == 'def f(a):\n    """Doc."""\n    logger.debug(\'starts\')\n    return a\n'
    assert edits.python_log("def f(a): return a\n") is None
    assert edits.javascript_log("function f(a) {\n  return a;\n}\n") == "function f(a) {\n  console.log('starts');\n  return a;\n}\n"
    assert edits.javascript_log("function f(a) { return a; }\n") is None and edits.javascript_log("function f() {\n  'use strict';\n}\n") is None


def functions(n):
    """Random Python functions that compute something, with guards among their statements."""
    rng = random.Random(11)
    for i in range(n):
        names = rng.sample(["total", "size", "user", "path", "ä", "left", "copy"], 4)
        lines, known = [], ["a", "b"]
        for name in names:
            value = rng.choice([str(rng.randrange(9)), rng.choice(known), f"{rng.choice(known)} + {rng.randrange(9)}", f"sum([{name} for {name} in (a, {rng.choice(known)})])", f"(lambda: {rng.choice(known)})()"])
            lines.append(f"    {name} = {value}")
            known.append(name)
            lines += rng.choice([[], [], [f"    if len(str({name})) > 3 or {name} < {rng.choice(known)}:", f"        {name} = {name} * 2"], [f"    if {name} < 0:", "        raise ValueError"], [f"    check_access({name})"]])
        yield i, "def f(a, b):\n" + "\n".join(lines) + f"\n    return {', '.join(known)}\n"


def test_edited_functions_give_what_they_gave():
    seen = dict.fromkeys([*edits.EDITS, "all"], 0)

    def run(code):
        space = {"logger": type("L", (), {"debug": staticmethod(lambda *_: None)}), "check_access": lambda x: x}
        exec(code, space)
        out = []
        for a, b in ((1, 2), (-3, 4), (100, 0)):
            try:
                out.append(space["f"](a, b))
            except ValueError as e:
                out.append(str(e))
        return out

    for _, code in functions(300):
        for kind in seen:
            new = edits.edit(code, "python", kind)
            if new is not None:
                seen[kind] += 1
                assert new != code and run(new) == run(code), (kind, code, new)
    assert seen["log"] == seen["all"] == 300 and seen["rename"] > 250 and seen["reorder"] > 20


def test_no_signal_on_a_thousand_functions(spark):
    script = "function f(a) {\n  const b = 1;\n  const c = %d;\n  if (a.length > c) {\n    throw new E();\n  }\n  return check_access(a, b);\n}\n"
    rows = [(i, code, "python") for i, code in functions(800)] + [(i, script % i, "javascript") for i in range(800, 1000)] + [(2000, None, "python"), (2001, "def f(", "python"), (2002, "x", None)]
    out = {r.edit: (r.n, r.n_edited, r.n_changed, r.n_labelled) for r in edits.signals(spark.createDataFrame(rows, "id long, code string, language string")).collect()}
    assert set(out) == {*edits.EDITS, "all"} and all(n == 1003 and changed == labelled == 0 for n, _, changed, labelled in out.values())
    assert out["all"][1] == out["log"][1] == 1000


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "def f():\n    x = 1\n", "python", 5, "y")], "id long, code string, language string, `a.b` int, edit string")
    out = edits.edited(rows).collect()
    assert [r.edit for r in out] == ["reorder", "rename", "log", "all"] and out[0].edited is None and {r["a.b"] for r in out} == {5}
    assert edits.edited(rows.limit(0)).count() == 0 and edits.signals(rows.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [*edits.EDITS, "all"])
def test_nothing_to_edit(kind):
    assert edits.edit(None, "python", kind) is None and edits.edit("", "javascript", kind) is None and edits.edit("def f():\n    pass\n", "go", kind) is None


def test_functions_that_differ_in_numbers_are_edited_once(monkeypatch):
    import random

    from palisade.operators import edits
    from palisade.plans.catalog import _FUNCTION

    rng, kinds = random.Random(6), [*edits.EDITS, "all"]
    for _ in range(100):
        for language, frame in _FUNCTION.items():
            code = frame % (rng.choice([0, 7, 1234, 98765, rng.randrange(10**6)]), rng.choice(["AUTO", "7777", "a 5000"]))
            assert edits._every(code, language) == [edits.edit(code, language, k) for k in kinds]
    calls, parse = [], edits.ast.parse
    edits._edits.cache_clear()
    monkeypatch.setattr(edits.ast, "parse", lambda code, *a, **b: calls.append(code) or parse(code, *a, **b))
    out = [edits._every(_FUNCTION["python"] % (n, "AUTO"), "python") for n in range(1000, 3000)]
    assert len(calls) < 20 and all(str(n) in x for n, row in zip(range(1000, 3000), out) for x in row)
