"""What conditions compare, and how short bodies end the flow.

A condition is taken apart into its ordering comparisons (`<`, `>`, `<=`, `>=`), each with
both of its sides; and, or, not and brackets only join them. A chain of comparisons is one.
Conditions that name a size or a limit are bounds, which weigh a little where they guard
nothing by themselves. A body ends the flow if its first statement does that writes no log.

Results for special rows: a condition without an ordering gives nothing, as does one that
is empty or breaks off; equal comparisons are given each.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

# --- fixed values -------------------------------------------------------------------

BOUNDS = r"\blen\(|\.length\b|\bsize\b|\bMAX|\bmax_|_max\b|limit|\bdepth\b|_LIMIT|_SIZE"
BOUNDS_WEIGHT = 0.25
LOGGING = r"(^|\.)(log|logger|logging|_logger|LOG|console|warnings|messages)\.\w+$|(^|\.)(print|warn|warning|error|info|debug|exception|log|flash|notify)$"
CLIENT_ERRORS = r"\b4(0[0-9]|1[0-9]|29)\b"
ASSERTIONS = frozenset({"assert", "assert.ok", "invariant", "console.assert"})

# ------------------------------------------------------------------------------------

_BOUNDS, _LOGGING = re.compile(BOUNDS, re.I), re.compile(LOGGING, re.I)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ORDER = (ast.Lt, ast.LtE, ast.Gt, ast.GtE)
# tokens that bind looser than an ordering, and brackets by where a walk meets them
_LOOSER = frozenset("&|?:,;=!")
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")

Token = tuple[str, int, int, int]  # text, line, start, end


def is_bound(atom: str) -> bool:
    return bool(_BOUNDS.search(atom))


def writes_log(callee: str) -> bool:
    return bool(_LOGGING.search(callee))


def python_atoms(condition: ast.expr) -> Iterator[tuple[str, int, set[str]]]:
    """(text, line, names) of each ordering in a condition."""
    for node in ast.walk(condition):
        if isinstance(node, ast.Compare) and any(isinstance(op, _ORDER) for op in node.ops):
            yield ast.unparse(node), node.lineno, {x.id for x in ast.walk(node) if isinstance(x, ast.Name)}


def _side(tokens: list[Token], at: int, stop: int, step: int) -> int:
    """The last token from `at` on, in steps towards `stop`, that belongs to one side of an ordering."""
    inner, outer = (_OPEN, _CLOSE) if step > 0 else (_CLOSE, _OPEN)
    depth, last = 0, at - step
    while at != stop:
        t = tokens[at][0]
        if not depth and (t in outer or t in _LOOSER):
            break
        depth += (t in inner) - (t in outer)
        last = at
        at += step
    return last


def javascript_atoms(tokens: list[Token], first: int, behind: int, code: str) -> Iterator[tuple[str, int, set[str]]]:
    """The same of the tokens from `first` up to `behind`."""
    touches = lambda a, b: first <= a and b < behind and tokens[a][3] == tokens[b][2]
    for k in range(first, behind):
        t = tokens[k][0]
        if t not in ("<", ">"):
            continue
        # a shift is no ordering
        if touches(k - 1, k) and tokens[k - 1][0] == t or touches(k, k + 1) and tokens[k + 1][0] == t:
            continue
        right = k + 2 if touches(k, k + 1) and tokens[k + 1][0] == "=" else k + 1
        a, b = _side(tokens, k - 1, first - 1, -1), _side(tokens, right, behind, 1)
        if a < k and b >= right:
            yield code[tokens[a][2] : tokens[b][3]], tokens[a][1], {x[0] for x in tokens[a : b + 1] if _NAME.fullmatch(x[0])}


def statements(tokens: list[Token], first: int, behind: int) -> list[tuple[int, int]]:
    """Ranges of tokens (first, behind) of the statements of a body: parted by semicolons, or by an end of a line that can end one."""
    out, depth, start = [], 0, first
    for k in range(first, behind):
        t = tokens[k][0]
        if k > start and not depth and tokens[k][1] > tokens[k - 1][1] and _NAME.fullmatch(t) and (tokens[k - 1][0] in _CLOSE or _NAME.fullmatch(tokens[k - 1][0]) or tokens[k - 1][0][0] in "'\"`0123456789"):
            out.append((start, k))
            start = k
        depth += (t in _OPEN) - (t in _CLOSE)
        if t == ";" and not depth:
            out.append((start, k))
            start = k + 1
    out.append((start, behind))
    return [(a, b) for a, b in out if a < b]


def callee(tokens: list[Token], first: int, behind: int) -> str:
    """The dotted name before a statement's first bracket."""
    stop = next((k for k in range(first, behind) if tokens[k][0] == "("), first)
    name = "".join(t[0] for t in tokens[first:stop])
    return name if re.fullmatch(r"[\w$.]+", name) else ""
