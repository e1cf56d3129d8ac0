"""Functions, definitions and calls of source files, and what is planned on them.

Python is read by its syntax tree. JavaScript is read by a scanner of tokens and braces:
function declarations, methods, arrow functions and functions assigned to a name; it knows
no grammar beyond that. Rows are distributed by file; each file is parsed once.

Results for special rows: a null content, or one that can't be parsed, gives no rows; an
unknown extension has no functions and is one unit as a whole; repeated files give
repeated rows; ties go to the first in the file; other columns are ignored.
"""

from __future__ import annotations

import ast
import difflib
import io
import itertools
import keyword
import re
import tokenize
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import text as T

from .names import top_per

IGNORE = "review-ignore"
MOST_UNITS = 50
SYMBOLS = "path string, kind string, name string, qualname string, start_line int, end_line int, position int, code string, caller string, caller_line int"

_JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\S", re.S)
_JS_WORDS = frozenset("if for while switch catch return function with do else try finally new typeof await async yield throw delete void in of case instanceof class super import export const let var".split())


class Symbol:
    __slots__ = ("kind", "name", "qual", "first", "last", "code", "caller", "caller_line")

    def __init__(self, kind, name, qual, first, last, code="", caller=None, caller_line=None):
        self.kind, self.name, self.qual, self.first, self.last, self.code, self.caller, self.caller_line = kind, name, qual, first, last, code, caller, caller_line


def _last_name(node: ast.AST) -> str:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def python_symbols(source: str) -> list[Symbol]:
    """Definitions (function, method, class, variable of the module) and calls, in order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = source.split("\n")
    out: list[Symbol] = []

    def text(node) -> str:
        part = lines[node.lineno - 1 : node.end_lineno]
        part[-1] = part[-1].encode()[: node.end_col_offset].decode("utf-8", "replace")
        part[0] = part[0].encode()[node.col_offset :].decode("utf-8", "replace")
        return "\n".join(part)

    def walk(node, owner, klass):
        for child in ast.iter_child_nodes(node):
            mine, inside = owner, klass
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if klass else "function"
                mine = Symbol(kind, child.name, f"{klass}.{child.name}" if klass else child.name, child.lineno, child.end_lineno, text(child))
                out.append(mine)
            elif isinstance(child, ast.ClassDef):
                inside = child.name
                out.append(Symbol("class", child.name, child.name, child.lineno, child.end_lineno, text(child)))
            elif isinstance(child, ast.Assign | ast.AnnAssign) and isinstance(node, ast.Module):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        out.append(Symbol("variable", target.id, target.id, child.lineno, child.end_lineno, text(child)))
            elif isinstance(child, ast.Call) and (name := _last_name(child.func)):
                out.append(Symbol("call", name, name, child.lineno, child.end_lineno, caller=owner and owner.qual, caller_line=owner and owner.first))
            walk(child, mine, inside)

    walk(tree, None, None)
    return out


def javascript_symbols(source: str) -> list[Symbol]:
    """Functions, methods, arrow functions and calls by tokens; an unclosed body runs to the end."""
    tokens, line, at = [], 1, 0
    for m in _JS_TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            tokens.append((m[0], line, m.start(), m.end()))
    closing: dict[int, int] = {}
    for opener, closer in ("{}", "()", "[]"):
        stack = []
        for i, t in enumerate(tokens):
            if t[0] == opener:
                stack.append(i)
            elif t[0] == closer and stack:
                closing[stack.pop()] = i
    word = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
    is_name = lambda i: bool(re.match(r"[A-Za-z_$]", word(i))) and word(i) not in _JS_WORDS
    classes = [(i, closing[j], word(i + 1)) for i in range(len(tokens)) if word(i) == "class" and is_name(i + 1) for j in [next((k for k in range(i, len(tokens)) if word(k) == "{"), -1)] if j in closing]
    spans: list[tuple[int, int, str, str, int]] = []  # first and last token, name, kind, where the name stands

    def add(start: int, body: int, name: str, kind: str) -> None:
        end = closing.get(body, len(tokens) - 1) if word(body) == "{" else body
        spans.append((start, end, name, kind, body))

    for i in range(len(tokens)):
        t = word(i)
        if t == "function":
            j = i + 1 + (word(i + 1) == "*")
            name = word(j) if is_name(j) else ""
            j += bool(name)
            if word(j) == "(" and j in closing and word(closing[j] + 1) == "{":
                if not name and word(i - 1) in ("=", ":") and is_name(i - 2):
                    name = word(i - 2)
                if name:
                    add(i, closing[j] + 1, name, "function")
        elif t == "=>":
            start = i - 1
            if word(start) == ")":
                start = next((o for o, c in closing.items() if c == start), start)
            if word(start - 1) == "async":
                start -= 1
            name = word(start - 2) if word(start - 1) in ("=", ":") and is_name(start - 2) else "<anonymous>"
            if word(i + 1) == "{":
                add(start, i + 1, name, "function")
            else:  # an expression: up to the end of its bracket, or of the statement
                depth, k = 0, i + 1
                while k < len(tokens):
                    depth += (word(k) in "([{") - (word(k) in ")]}")
                    if depth < 0 or depth == 0 and (word(k) in (",", ";") or k + 1 < len(tokens) and tokens[k + 1][1] > tokens[k][1] and word(k + 1) not in (".", "?", ":", "+", "&", "|")):
                        break
                    k += 1
                end = k - 1 if depth < 0 or word(min(k, len(tokens) - 1)) in (",", ";") else min(k, len(tokens) - 1)
                spans.append((start, max(end, i), name, "function", i))
        elif t == "(" and is_name(i - 1) and i in closing and word(closing[i] + 1) == "{" and word(i - 2) not in ("function", "*", ".", "new") and any(a < i < b for a, b, _ in classes):
            add(i - 1, closing[i] + 1, word(i - 1), "method")
    out = []
    for a, b, name in classes:
        out.append((a, Symbol("class", name, name, tokens[a][1], tokens[b][1], source[tokens[a][2] : tokens[b][3]])))
    made = []
    for a, b, name, kind, body in spans:
        holder = next((c for x, y, c in classes if kind == "method" and x < a < y), "")
        symbol = Symbol(kind, name, f"{holder}.{name}" if holder else name, tokens[a][1], tokens[b][1] + source.count("\n", tokens[b][2], tokens[b][3]), source[tokens[a][2] : tokens[b][3]])
        made.append((a, b, symbol))
        out.append((a, symbol))
    declared = {a - 1 for a, _, _ in made} | {i for i in range(len(tokens)) for a, b, name, kind, body in spans if kind == "method" and i == a}
    for i in range(len(tokens)):
        if word(i) == "(" and is_name(i - 1) and i - 1 not in declared and word(i - 2) != "function":
            inner = min(((b - a, s) for a, b, s in made if a <= i - 1 <= b), key=lambda x: x[0], default=(0, None))[1]
            out.append((i - 1, Symbol("call", word(i - 1), word(i - 1), tokens[i - 1][1], tokens[i - 1][1], caller=inner and inner.qual, caller_line=inner and inner.first)))
        elif word(i) in ("const", "let", "var") and is_name(i + 1) and word(i + 2) == "=" and not any(a <= i <= b for a, b, _ in made):
            if not any(a in (i + 3, i + 4) for a, _, _ in made):
                out.append((i, Symbol("variable", word(i + 1), word(i + 1), tokens[i][1], tokens[i][1], "")))
    return [s for _, s in sorted(out, key=lambda x: (x[0], x[1].kind == "call"))]


def symbols_of(path: str, source: str | None) -> list[Symbol]:
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if source is None or ext not in T.EXTENSIONS:
        return []
    return python_symbols(source) if ext == ".py" else javascript_symbols(source)


def symbols(files: DataFrame) -> DataFrame:
    """files (path, content) to one row per definition and call, with its place in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for batch in batches:
            rows = [(p, s.kind, s.name, s.qual, s.first, s.last, i, s.code, s.caller, s.caller_line) for p, c in zip(batch["path"], batch["content"]) if p is not None for i, s in enumerate(symbols_of(p, c))]
            yield pd.DataFrame(rows, columns=names).astype({"caller_line": "Int32"})

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def functions(found: DataFrame) -> DataFrame:
    """The functions and methods of `symbols`: (path, name, start_line, end_line, position, code)."""
    return found.filter(F.col("kind").isin("function", "method")).select("path", "name", "start_line", "end_line", "position", "code")


# --- planning ------------------------------------------------------------------------

def changed_lines(given: Column, from_patch: Column) -> Column:
    """The lines to look at: those given, even if none, else those of the patch, else null for all."""
    return F.coalesce(given, from_patch)


def plan_units(files: DataFrame, most: int = MOST_UNITS, request: str | None = None) -> DataFrame:
    """files (path, content, changed_lines array or null[, request]) to review units, with `dropped` for those beyond the cap.

    A function is a unit if it meets a changed line and has no directive to ignore it; a
    file is one as a whole if its language is not known, if it has changed lines outside
    functions, or has none of either and no functions.
    """
    by = [request] if request else []
    keyed = files.select(*by, "path", "content", "changed_lines").withColumn("known", T.language_of(F.col("path")).isNotNull())
    keyed = keyed.withColumn("lines", F.split(F.coalesce("content", F.lit("")), "\n"))
    found = functions(symbols(keyed.select("path", "content").distinct()))
    inside = keyed.filter("known").join(found, "path")
    meets = F.col("changed_lines").isNull() | F.exists("changed_lines", lambda x: x.between(F.col("start_line"), F.col("end_line")))
    # on the function's own lines or the one above
    own = F.slice("lines", F.greatest(F.lit(1), F.col("start_line") - 1), F.col("end_line") - F.greatest(F.lit(1), F.col("start_line") - 1) + 1)
    ignored = F.exists(own, lambda x: F.contains(x, F.lit(IGNORE)))
    clip = F.filter("changed_lines", lambda x: x.between(F.col("start_line"), F.col("end_line")))
    units = inside.filter(meets & ~ignored).select(*by, "path", F.col("name").alias("function_name"), "start_line", "end_line", "position", "code", F.array_sort(clip).alias("changed_lines"))
    spans = inside.groupBy(*by, "path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))  # functions of one file
    whole = keyed.join(spans, [*by, "path"], "left")
    outside = F.exists("changed_lines", lambda x: ~F.exists(F.coalesce("spans", F.array().cast("array<struct<start_line:int,end_line:int>>")), lambda s: x.between(s["start_line"], s["end_line"])))
    kept = units.groupBy(*by, "path").agg(F.count("*").alias("n"))
    whole = whole.join(kept, [*by, "path"], "left")
    needed = ~F.col("known") | F.when(F.col("changed_lines").isNull(), F.col("n").isNull()).otherwise(outside)
    end = F.greatest(F.lit(1), T.line_count(F.coalesce("content", F.lit(""))))
    whole = whole.filter(needed & ~F.coalesce(F.contains("content", F.lit(IGNORE)), F.lit(False)))
    whole = whole.select(*by, "path", F.lit(None).cast("string").alias("function_name"), F.lit(1).alias("start_line"), end.alias("end_line"), F.lit(1 << 30).alias("position"), F.col("content").alias("code"), F.array_sort("changed_lines").alias("changed_lines"))
    units = units.unionByName(whole)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("path", "position")) if by else None
    if place is None:
        return units.withColumn("dropped", F.lit(False))
    return units.withColumn("dropped", place > most)


# --- lookups -------------------------------------------------------------------------

def last_segment(symbol: Column) -> Column:
    """The last part of a requested name ("mod.Cls.m()" is "m")."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(symbol), "^[`'\"]+|[`'\"]+$", ""), r"\(\)$", "")
    return F.trim(F.regexp_extract(bare, r"([^.:#]*)$", 1))


def definitions(found: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, symbol, file) to their definitions; a file that has none of them hides nothing."""
    defs = found.filter("kind <> 'call'").select("path", "kind", "name", "qualname", "start_line", "end_line", "position", "code")
    asked = requests.select("id", "symbol", "file", last_segment(F.col("symbol")).alias("_last"))
    file = F.regexp_replace(F.trim("file"), r"^[./]+", "")
    both = asked.filter("_last <> ''").join(defs, F.col("_last") == F.col("name"))
    here = (F.col("path") == file) | F.col("path").endswith(F.concat(F.lit("/"), file)) | F.endswith(file, F.concat(F.lit("/"), F.col("path")))
    both = both.withColumn("_here", F.coalesce(here & (file != ""), F.lit(False)))
    some = F.max("_here").over(Window.partitionBy("id"))
    return both.withColumn("_some", some).filter("_here or not _some").drop("_here", "_some", "_last", "symbol", "file")


def callers(found: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, symbol) to the functions that call a name, each once."""
    calls = found.filter("kind = 'call' and caller is not null").select("path", F.col("name").alias("_callee"), F.col("caller").alias("qualname"), F.col("caller_line").alias("start_line"))
    hit = requests.select("id", last_segment(F.col("symbol")).alias("_callee")).join(calls, "_callee").select("id", "path", "qualname", "start_line").distinct()
    return hit.join(found.filter(F.col("kind").isin("function", "method")).select("path", "qualname", "start_line", "kind", "name", "end_line", "position", "code"), ["path", "qualname", "start_line"])


def callees(found: DataFrame, of: DataFrame) -> DataFrame:
    """of (id, path, qualname, start_line) to the definitions of what each calls, itself and variables left out."""
    calls = found.filter("kind = 'call'").select("path", F.col("caller").alias("qualname"), F.col("caller_line").alias("start_line"), F.col("name").alias("_callee"))
    names = of.join(calls, ["path", "qualname", "start_line"]).select("id", F.col("path").alias("_path"), F.col("start_line").alias("_start"), "_callee").distinct()
    defs = found.filter(~F.col("kind").isin("call", "variable")).select("path", "kind", "name", "qualname", "start_line", "end_line", "position", "code")
    return names.join(defs, F.col("_callee") == F.col("name")).filter("path <> _path or start_line <> _start").drop("_path", "_start", "_callee")


def context_definitions(found: DataFrame, changed: DataFrame, most: int = 4) -> DataFrame:
    """changed (path, qualname, name, start_line) to the first callers and callees of each file's changed functions."""
    asked = changed.select(F.col("path").alias("id"), "path", "qualname", F.col("name").alias("symbol"), "start_line")
    near = callers(found, asked.select("id", "symbol").distinct()).select("id", "path", "qualname", "kind", "start_line", "end_line", "position", "code")
    near = near.unionByName(callees(found, asked.select("id", "path", "qualname", "start_line")).select("id", "path", "qualname", "kind", "start_line", "end_line", "position", "code")).distinct()
    near = near.filter("kind <> 'class'").join(changed.select("path", "qualname", "start_line").distinct(), ["path", "qualname", "start_line"], "left_anti")
    return top_per(near, ["id"], ["path", "position"], most)


def resolve_paths(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names (id, name) with `path`: the equal one, else the only one of which either is an end of the other.

    Names and paths meet by their last component.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    name = F.regexp_replace(F.trim("name"), r"^(\./|/)+", "")
    asked, known = names.withColumn("_name", name).withColumn("_last", last(F.col("_name"))), paths.select("path").distinct().withColumn("_last", last(F.col("path")))
    both = asked.join(known, "_last")
    equal = F.col("path") == F.col("_name")
    ends = F.endswith("path", F.concat(F.lit("/"), F.col("_name"))) | F.endswith("_name", F.concat(F.lit("/"), F.col("path")))
    found = both.filter(equal | ends).groupBy("id").agg(F.max(F.when(equal, F.col("path"))).alias("_equal"), F.count("*").alias("_n"), F.max("path").alias("_any"))
    return names.join(found.select("id", F.coalesce("_equal", F.when(F.col("_n") == 1, F.col("_any"))).alias("path")), "id", "left")


def pair_functions(old: DataFrame, new: DataFrame, hunks: DataFrame) -> DataFrame:
    """Functions (file, name, code, language, start_line, end_line) before and after a change, by a name that is unique before.

    hunks (file, first, last): changed ranges after the change. Equal code, code that
    differs in white space or comments alone, and functions outside the hunks are no pairs.
    """
    once = old.withColumn("_n", F.count("*").over(Window.partitionBy("file", "name"))).filter("_n = 1").select("file", "name", F.col("code").alias("old_code"))
    both = new.join(once, ["file", "name"]).filter("code <> old_code")
    both = both.filter(~T.same_but_space(F.col("old_code"), F.col("code"), F.col("language")))
    ranges = hunks.groupBy("file").agg(F.collect_list(F.struct("first", "last")).alias("_hunks"))  # of one file's patch
    touched = F.exists("_hunks", lambda h: (h["first"] <= F.col("end_line")) & (F.col("start_line") <= h["last"]))
    return both.join(ranges, "file").filter(touched).drop("_hunks").withColumnRenamed("code", "new_code")


# --- statements ------------------------------------------------------------------------

# Words counted in changed lines, by category, and marks of a rename that may be a fix (fixed values).
SECURITY_TOKENS = {
    "sqli": [r"execute", r"cursor", r"query", r"SELECT", r"%s", r"format", r"\bf[\"']"],
    "cmd_injection": [r"subprocess", r"os\.system", r"popen", r"shell=", r"exec", r"eval"],
    "path_traversal": [r"os\.path", r"open\(", r"join", r"realpath", r"normpath", r"\.\.", r"safe_join"],
    "xss": [r"escape", r"Markup", r"innerHTML", r"sanitize", r"html"],
    "ssrf": [r"requests\.", r"urlopen", r"http", r"url", r"host"],
    "deserialization": [r"pickle", r"yaml\.load", r"marshal", r"unserialize"],
    "weak_crypto": [r"md5", r"sha1", r"random", r"\bDES\b", r"RC4", r"hashlib"],
    "open_redirect": [r"redirect", r"next", r"url"],
    "authz": [r"permission", r"is_authenticated", r"role", r"owner", r"user\.id", r"403"],
    "redos": [r"\bre\.", r"regex", r"compile", r"match"],
    "xxe": [r"etree", r"lxml", r"resolve_entities", r"XMLParser"],
    "secrets": [r"key", r"token", r"secret", r"password"],
    "prototype_pollution": [r"__proto__", r"prototype", r"constructor", r"hasOwnProperty", r"Object\.assign", r"merge"],
}
RENAME_MARKS = [r"safe", r"secur", r"saniti[sz]", r"escape", r"valid"]


def security_tokens(text: str, category: str | None) -> int:
    """Hits of a category's words, the longer patterns first; of all words for another category."""
    words = SECURITY_TOKENS.get(category) or sorted({p for ps in SECURITY_TOKENS.values() for p in ps})
    return len(re.findall("|".join(f"(?:{p})" for p in sorted(words, key=len, reverse=True)), text, re.I))


def statement_tokens(code: str, language: str) -> dict[int, list[tuple[str, str]]]:
    """(kind, text) of the tokens of each line that has any; comments, docstrings and quote styles left out."""
    out: dict[int, list[tuple[str, str]]] = defaultdict(list)
    if language == "javascript":
        line, at = 1, 0
        for m in _JS_TOKEN.finditer(code):
            line += code.count("\n", at, m.start())
            at = m.start()
            t = m[0]
            if t.startswith(("//", "/*")):
                continue
            kind = "str" if t[0] in "'\"`" else "num" if t[0].isdigit() else "id" if re.match(r"[\w$]", t) and t not in _JS_WORDS else "op"
            out[line].append((kind, t[1:-1] if kind == "str" else t))
        return _without_last_commas(out)
    statement: list[tuple[int, str, str]] = []

    def flush() -> None:
        if any(k != "str" for _, k, _ in statement):  # else a text that stands alone
            for n, k, t in statement:
                out[n].append((k, t))
        statement.clear()

    try:
        for t in tokenize.generate_tokens(io.StringIO(code if code.endswith("\n") else code + "\n").readline):
            if t.type in (tokenize.NEWLINE, tokenize.ENDMARKER) or t.type == tokenize.OP and t.string == ";":
                flush()
            elif t.type == tokenize.NAME:
                statement.append((t.start[0], "op" if keyword.iskeyword(t.string) else "id", t.string))
            elif t.type == tokenize.NUMBER:
                statement.append((t.start[0], "num", t.string))
            elif t.type == tokenize.STRING:
                m = re.match(r"([A-Za-z]*)('''|\"\"\"|'|\")", t.string)
                statement.append((t.start[0], "str", f"{m[1].lower()}|{t.string[m.end() : -len(m[2])]}" if m else t.string))
            elif t.type == tokenize.OP:
                statement.append((t.start[0], "op", t.string))
            elif t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING):
                statement.append((t.start[0], "str" if "FSTRING" in tokenize.tok_name[t.type] else "op", t.string))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        flush()
    return _without_last_commas(out)


def _without_last_commas(lines: dict[int, list[tuple[str, str]]]) -> dict[int, list[tuple[str, str]]]:
    """Without the comma that ends a line before a closing bracket, so that wrapping a call differently is no change."""
    numbers = sorted(lines)
    for n, after in zip(numbers, numbers[1:]):
        if lines[n][-1] == ("op", ",") and lines[after][0][1] in (")", "]", "}"):
            lines[n].pop()
    return {n: lines[n] for n in numbers if lines[n]}


def _paired(old: list, new: list) -> list[tuple[int, int]]:
    """Places of equal elements in the two lists' alignment."""
    blocks = difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()
    return [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]


def _gaps(pairs: list[tuple[int, int]], n_old: int, n_new: int) -> list[tuple[range, range]]:
    """What lies between aligned places."""
    edges = [(-1, -1), *pairs, (n_old, n_new)]
    return [(range(a + 1, c), range(b + 1, d)) for (a, b), (c, d) in zip(edges, edges[1:]) if c - a > 1 or d - b > 1]


def _couples(old: list[list[tuple]], new: list[list[tuple]], gap: tuple[range, range]) -> list[tuple[range, range]]:
    """Parts of a gap that may differ in names alone: all of it, else lines of one shape."""
    shape = lambda line: tuple((k, k == "id" or t) for k, t in line)
    left, right = ([shape(side[i]) for i in part] for side, part in zip((old, new), gap))
    if left and right and sum(left, ()) == sum(right, ()):
        return [gap]
    return [(gap[0][i : i + 1], gap[1][j : j + 1]) for i, j in _paired(left, right)]


def diff_quality(old: str, new: str, language: str, category: str | None) -> dict:
    """Changed statement lines of a pair. Lines that differ by renames count only if these are no one-to-one relation of all names."""
    sides = [statement_tokens(x or "", language) for x in (old, new)]
    lines = [list(side.values()) for side in sides]
    same = _paired(*([tuple(line) for line in side] for side in lines))
    gaps = _gaps(same, *map(len, lines))
    couples = [(range(i, i + 1), range(j, j + 1)) for i, j in same] + [couple for gap in gaps for couple in _couples(*lines, gap)]

    names = [[t for i in part for k, t in lines[side][i] if k == "id"] for couple in couples for side, part in enumerate(couple)]
    relation = [set(zip(a, b)) for a, b in zip(names[::2], names[1::2])]
    pairs = set().union(*relation)
    lefts, rights = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    odd = {(a, b) for a, b in pairs if lefts[a] > 1 or rights[b] > 1}

    changed = [{i for gap in gaps for i in gap[side]} for side in (0, 1)]
    renames = [(couple, held) for couple, held in list(zip(couples, relation))[len(same) :] if not held & odd]
    renamed = {(a, b) for _, held in renames for a, b in held if a != b}
    n = sum(len(changed[side] - {i for couple, _ in renames for i in couple[side]}) for side in (0, 1))
    words = " ".join(itertools.chain(*renamed))
    source = [(x or "").split("\n") for x in (old, new)]
    text = "\n".join(source[side][list(sides[side])[i] - 1].strip() for side in (0, 1) for i in sorted(changed[side]))
    return {
        "changed_stmt_lines": n, "rename_only": n == 0 and bool(renamed), "renamed": sorted(f"{a}>{b}" for a, b in renamed),
        "security_rename": bool(renamed) and (security_tokens(words, category) > 0 or bool(re.search("|".join(RENAME_MARKS), words, re.I))), "security_tokens": security_tokens(text, category),
    }


QUALITY = "changed_stmt_lines int, rename_only boolean, renamed array<string>, security_rename boolean, security_tokens int"


def with_quality(pairs: DataFrame, old: str = "vulnerable_code", new: str = "fixed_code") -> DataFrame:
    """Adds `quality` of each pair's diff; pairs (language, category and the two codes)."""

    @F.pandas_udf(QUALITY)
    def run(a: pd.Series, b: pd.Series, language: pd.Series, category: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([diff_quality(*x) for x in zip(a, b, language, category)], columns=[c.split()[0] for c in QUALITY.split(", ")])

    return pairs.withColumn("quality", run(F.col(old), F.col(new), F.col("language"), F.col("category")))


def comment_lines(code: str, language: str) -> list[int]:
    """Lines with text but no statement: comments, and texts that stand alone."""
    if language not in ("python", "javascript"):
        return []
    stated, out = statement_tokens(code, language), []
    # a token of several lines covers them all
    covered: set[int] = set(stated)
    if language == "python":
        try:
            for node in ast.walk(ast.parse(code)):
                if isinstance(node, ast.Constant | ast.JoinedStr) and hasattr(node, "end_lineno") and node.lineno in stated:
                    covered.update(range(node.lineno, node.end_lineno + 1))
        except (SyntaxError, ValueError, RecursionError):
            return []
    else:
        line, at = 1, 0
        for m in _JS_TOKEN.finditer(code):
            line += code.count("\n", at, m.start())
            at = m.start()
            if m[0].startswith("`"):
                covered.update(range(line, line + m[0].count("\n") + 1))
    for i, text in enumerate(code.split("\n"), 1):
        if text.strip() and i not in covered:
            out.append(i)
    return out


def with_statements(rows: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Adds n_statement_lines and comment_lines; null code has none."""

    @F.pandas_udf("n_statement_lines int, comment_lines array<int>")
    def run(codes: pd.Series, languages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(statement_tokens(c or "", g or "python")), comment_lines(c or "", g or "")) for c, g in zip(codes, languages)], columns=["n_statement_lines", "comment_lines"])

    kept = [c for c in rows.columns if c not in ("n_statement_lines", "comment_lines", "_s")]
    return rows.withColumn("_s", run(F.col(code), F.col(language))).select(*kept, "_s.n_statement_lines", "_s.comment_lines")


def decorated_start(lines: Column, start: Column) -> Column:
    """The first of the decorator lines right above a line, else the line."""
    above = F.reverse(F.slice(lines, 1, F.greatest(F.lit(0), start - 1)))
    run = F.aggregate(above, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & F.ltrim(x).startswith("@")).alias("on"), (s["n"] + F.when(s["on"] & F.ltrim(x).startswith("@"), 1).otherwise(0)).alias("n")))
    return start - run["n"]


def elided(lines: Column, keep: Column, first: Column) -> Column:
    """Numbered lines with those not kept (places from 0) as one mark for each gap."""
    n = F.size(lines)
    kept = lambda i: F.array_contains(keep, i)
    start = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~kept(i) & ((i == 0) | kept(i - 1)))

    def shown(i):
        stop = F.coalesce(F.array_min(F.filter(keep, lambda k: k > i)), n)
        span = F.when(stop - i == 1, F.concat(F.lit("line "), (first + i).cast("string"))).otherwise(F.concat(F.lit("lines "), (first + i).cast("string"), F.lit("-"), (first + stop - 1).cast("string")))
        return F.concat(F.lit("... | [... "), (stop - i).cast("string"), F.lit(" line(s) omitted: "), span, F.lit(" ...]"))

    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(kept(i), F.concat((first + i).cast("string"), F.lit(" | "), F.get(lines, i))).when(F.array_contains(start, i), shown(i)))
    return F.array_join(F.filter(rows, lambda x: x.isNotNull()), "\n")
