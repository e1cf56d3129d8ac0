"""Edits of a function that keep its meaning, as a control of what signals say.

Each edit is made where it is surely harmless, and not at all where that can't be seen: a
local variable gets another name in its scope and in the scopes that read it there; two
assignments in a row that don't touch each other change places; a line is logged first.
Python is edited by its syntax tree, JavaScript by its tokens. What is edited must give no
change of guards: `signals` counts the functions for which it does.

Results for special rows: code that is null, can't be parsed, has no function or another
language is not edited (null); edits keep all other characters; equal ids are functions of
their own only in `edited`; empty tables give empty tables; an edit with no function has no
row in `signals`; columns of any name go through `edited`, but for those that it adds.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .code import _JS_TOKEN, _JS_WORDS

SUFFIX = "_renamed"
LOG = {"python": "logger.debug('starts')", "javascript": "console.log('starts');"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
# what can neither fail, nor see or change anything but the names in it
_PLAIN = (ast.Name, ast.Constant, ast.Tuple, ast.List, ast.Dict, ast.Load)


def _fresh(name: str, code: str) -> str:
    new = name + SUFFIX
    while new in code:
        new += "_"
    return new


# --- Python

def _function(code: str) -> ast.FunctionDef | ast.AsyncFunctionDef | None:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return next((n for n in ast.walk(tree) if isinstance(n, _FUNCTIONS)), None)


def _within(body: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes of a scope; inner scopes are given and not entered."""
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, _SCOPES):
            todo += reversed(list(ast.iter_child_nodes(node)))


def _byte_places(code: str, spots: set[tuple[int, int]]) -> list[int]:
    """Places in the UTF-8 code of (line, byte column)."""
    starts = [0]
    for line in code.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    return sorted(starts[line - 1] + column for line, column in spots)


def python_rename(code: str) -> str | None:
    """The first local variable that every mention in the function means is renamed.

    Not one that an inner scope binds too, that is global or nonlocal, bound other than by
    an assignment or loop, or in a function that looks its own names up.
    """
    f = _function(code)
    if f is None:
        return None
    nodes = list(ast.walk(f))
    if any(isinstance(n, ast.Name) and n.id in ("locals", "vars", "eval", "exec", "globals", "dir") for n in nodes):
        return None
    bound = [n for n in _within(f.body) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
    other = {x.arg for x in nodes if isinstance(x, ast.arg)} | {n.name for n in nodes if isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name}
    other |= {(a.asname or a.name).partition(".")[0] for n in nodes if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    other |= {name for n in nodes if isinstance(n, ast.Global | ast.Nonlocal) for name in n.names}
    # formatted texts before Python 3.12 have no places of their own
    other |= {x.id for n in nodes if isinstance(n, ast.JoinedStr) for x in ast.walk(n) if isinstance(x, ast.Name)}
    own = {id(n) for n in _within(f.body)}
    other |= {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del) and id(n) not in own}
    # a default, a decorator or an annotation is read outside
    other |= {x.id for part in [f.args, *f.decorator_list, *([f.returns] if f.returns else [])] for x in ast.walk(part) if isinstance(x, ast.Name)}
    name = next((n.id for n in sorted(bound, key=lambda n: (n.lineno, n.col_offset)) if n.id not in other and not n.id.startswith("__")), None)
    if name is None:
        return None
    raw, new = code.encode(), _fresh(name, code).encode()
    old, out, last = name.encode(), [], 0
    for at in _byte_places(code, {(n.lineno, n.col_offset) for n in nodes if isinstance(n, ast.Name) and n.id == name}):
        if raw[at : at + len(old)] != old:
            return None  # written in another form of the same letters
        out += [raw[last:at], new]
        last = at + len(old)
    return b"".join([*out, raw[last:]]).decode()


def _body(f: ast.FunctionDef | ast.AsyncFunctionDef) -> list[ast.stmt]:
    """Statements behind the docstring."""
    first = f.body[0]
    documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    return f.body[1:] if documented else f.body


def _alone(code: str, s: ast.stmt) -> bool:
    """Whether a statement is all of its one line."""
    line = code.split("\n")[s.lineno - 1].encode()
    return s.lineno == s.end_lineno and not line[: s.col_offset].strip() and not line[s.end_col_offset :].strip()


def python_log(code: str) -> str | None:
    f = _function(code)
    if f is None or not (body := _body(f)) or "\r" in code or "\f" in code:
        return None
    lines, first = code.split("\n"), body[0]
    at = min([first.lineno, *[d.lineno for d in getattr(first, "decorator_list", [])]]) - 1
    if lines[at].encode()[: first.col_offset].strip():
        return None  # behind the head, or another statement
    return "\n".join([*lines[:at], lines[at][: first.col_offset] + LOG["python"], *lines[at:]])


def python_reorder(code: str) -> str | None:
    """Two assignments to a name each, in lines of their own, of which at least one has a plain value."""
    f = _function(code)
    if f is None or "\r" in code or "\f" in code or any(isinstance(n, ast.Global | ast.Nonlocal) for n in ast.walk(f)):
        return None

    def kind(s: ast.stmt) -> tuple[str, set[str], bool] | None:
        if not (isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and _alone(code, s)):
            return None
        inside = list(ast.walk(s.value))
        return s.targets[0].id, {n.id for n in inside if isinstance(n, ast.Name)}, all(isinstance(n, _PLAIN) for n in inside)

    local = {x.arg for x in ast.walk(f.args) if isinstance(x, ast.arg)}
    for s in f.body:
        local |= {n.id for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} if kind(s) else set()
    for a, b in zip(_body(f), _body(f)[1:]):
        x, y = kind(a), kind(b)
        if not x or not y or b.lineno != a.lineno + 1 or x[0] == y[0] or x[0] in y[1] or y[0] in x[1]:
            continue
        # what is not plain may change any name but a local one, and is told apart from a failure of the plain one only if that can't fail
        plain = x if x[2] else y if y[2] else None
        if plain is None or not plain[1] <= {p.arg for p in ast.walk(f.args) if isinstance(p, ast.arg)} and not (x[2] and y[2] and plain[1] <= local):
            continue
        lines = code.split("\n")
        lines[a.lineno - 1], lines[b.lineno - 1] = lines[b.lineno - 1], lines[a.lineno - 1]
        return "\n".join(lines)
    return None


# --- JavaScript

def _js(code: str) -> list[re.Match]:
    return [m for m in _JS_TOKEN.finditer(code) if not m[0].startswith(("//", "/*"))]


def _js_opened(tokens: list[re.Match]) -> int | None:
    """The bracket that opens the first function's body."""
    depth, seen = 0, False
    for i, m in enumerate(tokens):
        t = m[0]
        seen |= t in ("function", "=>")
        if t == "{" and seen and not depth:
            return i
        depth += (t in "([") - (t in ")]")
    return None


def javascript_rename(code: str) -> str | None:
    """The first variable that is declared once and of whose every mention it is certain that it is meant."""
    tokens = _js(code)
    opened = _js_opened(tokens)
    if opened is None:
        return None
    word = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
    declared = [word(i + 1) for i in range(opened, len(tokens)) if word(i) in ("const", "let", "var") and _NAME.fullmatch(word(i + 1) or " ")]
    templates = " ".join(t[0] for t in tokens if t[0].startswith("`"))
    for name in dict.fromkeys(declared):
        at = [i for i in range(len(tokens)) if word(i) == name and word(i - 1) != "."]
        # fields of objects, labels, parameters and short forms look like mentions
        unsure = any(word(i + 1) in (":", "=>") or word(i - 1) in ("{", "function", "class", "?") or word(i - 1) == "," and word(i + 1) in (",", "}", ")") or word(i - 1) == "(" and word(i + 1) in (",", ")") and word(i + 2) in ("=>", "{") for i in at)
        if declared.count(name) > 1 or name in templates or unsure or at[0] < opened or name in _JS_WORDS or not name.isascii() or "/" in code.replace("//", ""):
            continue
        new, out, last = _fresh(name, code), [], 0
        for i in at:
            out += [code[last : tokens[i].start()], new]
            last = tokens[i].end()
        return "".join([*out, code[last:]])
    return None


def javascript_log(code: str) -> str | None:
    tokens = _js(code)
    opened = _js_opened(tokens)
    if opened is None or opened + 1 >= len(tokens) or tokens[opened + 1][0].startswith(("'", '"')):
        return None  # nothing in it, or a directive
    at = tokens[opened].end()
    end = code.find("\n", at)
    if end < 0 or code[at:end].strip():
        return None
    inner = re.match(r"[ \t]*", code[end + 1 :])[0]
    return f"{code[: end + 1]}{inner}{LOG['javascript']}\n{code[end + 1 :]}"


_JS_PLAIN = re.compile(r"([ \t]*)(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*((?:true|false|null|\d+|'[^'\\\n]*'|\"[^\"\\\n]*\"))\s*;[ \t]*")


def javascript_reorder(code: str) -> str | None:
    """Two declarations in a row, in lines of their own, with constant values."""
    tokens = _js(code)
    opened = _js_opened(tokens)
    if opened is None or "`" in code or "/*" in code:
        return None
    lines, first = code.split("\n"), code.count("\n", 0, tokens[opened].end()) + 1
    for i in range(first, len(lines) - 1):
        a, b = _JS_PLAIN.fullmatch(lines[i]), _JS_PLAIN.fullmatch(lines[i + 1])
        if a and b and a[1] == b[1] and a[2] != b[2]:
            lines[i], lines[i + 1] = lines[i + 1], lines[i]
            return "\n".join(lines)
    return None


EDITS: dict[str, dict[str, Callable[[str], str | None]]] = {
    "reorder": {"python": python_reorder, "javascript": javascript_reorder},
    "rename": {"python": python_rename, "javascript": javascript_rename},
    "log": {"python": python_log, "javascript": javascript_log},
}


def edit(code: str | None, language: str | None, kind: str) -> str | None:
    """Code after one edit, or after `all` that can be made; null where there is none."""
    if code is None:
        return None
    if kind != "all":
        run = EDITS[kind].get(language or "")
        return run(code) if run else None
    out = code
    for one in EDITS:
        out = edit(out, language, one) or out
    return out if out != code else None


@lru_cache(maxsize=4096)
def _edits(code: str, language: str | None) -> tuple[str | None, ...]:
    """Code after each edit and after all; edits of the last codes are remembered."""
    return tuple(edit(code, language, k) for k in (*EDITS, "all"))


def _every(code: str | None, language: str | None) -> list[str | None]:
    if code is None:
        return [None] * (len(EDITS) + 1)
    (code,), numbers = features.numbered(code)
    return [c and features.filled(c, numbers) for c in _edits(code, language)]


def edited(rows: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """rows with `edit` (reorder, rename, log, all) and `edited`: a row for each."""
    kinds = [*EDITS, "all"]

    @F.pandas_udf("array<string>")
    def run(codes: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([_every(c, g) for c, g in zip(codes, languages)], dtype=object)

    names = F.array(*map(F.lit, kinds))
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns if c not in ("edit", "edited")]
    both = F.explode(F.arrays_zip(names.alias("edit"), run(F.col(code), F.col(language)).alias("edited")))
    return rows.select(*columns, both.alias("_e")).select(*columns, F.col("_e.edit"), F.col("_e.edited"))


def signals(functions: DataFrame) -> DataFrame:
    """functions (id, code, language) by edit: how many there are, were edited, and have a change of guards or a label for it."""
    rows = edited(functions.select("id", "code", "language"))
    kinds = F.array(*map(F.lit, [*EDITS, "all"]))
    units = rows.filter("edited is not null").select((F.col("id") * F.size(kinds) + F.array_position(kinds, F.col("edit")) - 1).alias("id"), "edit", F.col("code").alias("old"), F.col("edited").alias("new"), "language")
    found = features.risk(features.changes(features.features(units, language="language", differing=True))).select("id", "risk")
    there = units.select("id", "edit").join(found, "id", "left").groupBy("edit").agg(F.count("*").alias("n_edited"), F.count("risk").alias("n_changed"), F.count_if(F.col("risk") != "none").alias("n_labelled"))
    return rows.groupBy("edit").agg(F.count("*").alias("n")).join(there, "edit", "left").na.fill(0, ["n_edited", "n_changed", "n_labelled"])
