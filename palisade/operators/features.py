"""Guard features of code and their signed changes.

Python is read by its syntax tree, JavaScript by its tokens; interfaces that are unsafe and
the flags of calls are found by patterns on code without comments and prose. Features are
rows, so that changes are relational: equal (family, key) cancel as multisets, the rest
nets per (family, kind, group), and hazards that meet a loss of safe twins pair as swaps.
Swapping the sides flips every direction.

Results for special rows: no code, code that can't be parsed, another language, or one
side alone that is missing give no features, hence no change; repeated ids are one unit;
empty tables give empty tables.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

from . import conditions
from .code import _JS_TOKEN, _JS_WORDS
from .diffs import diff_rows
from .sets import occurrence

LEAST, MARGIN, ALERT = 0.5, 0.25, 0.7
#: Kind of what is read only so that it can cancel the same thing under other names.
NO_KIND = "none"

# --- fixed values -------------------------------------------------------------------

# Calls that guard something, by the last part of their name: kind, pattern, weight; the first that fits whole.
GUARD_CALLS = (
    ("auth_check", r"has_?perms?|has_?permissions?|has_object_permission|check_?perms?\w*|check_?permissions?\w*|check_?access\w*|check_?auth\w*|checkAuth\w*|require_?(login|auth|perm|admin|role|scope|user|owner)\w*|requireAuth\w*|\w*login_required|\w*permission_required|user_passes_test|staff_member_required|require_\w*(login|auth)\w*|is_?authenticated|is_?authori[sz]ed|authori[sz]e\w*|isLoggedIn|ensureLoggedIn|ensure_?(authenticated|logged_in|admin|owner|permission)\w*|can_?(access|edit|view|read|write|delete|modify|manage|admin|update)\w*|is_?admin|is_?owner|is_?superuser|is_?staff|compare_digest|timingSafeEqual|constant_time_compare|safe_str_cmp|verify\w*|csrf_protect|validate_csrf\w*|check_csrf\w*|protect_from_forgery", 0.6),
    ("path_containment", r"realpath|commonpath|commonprefix|is_relative_to|relative_to|safe_?join\w*|safeJoin\w*|safe_?path\w*|secure_filename|sanitize_?filename|sanitizeFilename|basename|resolve_?safe\w*", 0.55),
    ("sanitiser", r"(?!\w*unescape)\w*escape\w*|htmlspecialchars|conditional_escape|format_html|escape_?js|escapejs|escape_?string|escape_?like|escapeId|escapeRegExp|escape_?regex|escape_?shell\w*|escapeshellarg|quote|quote_plus|shlex_quote|\w*saniti[sz]e\w*|\w*Saniti[sz]e\w*|clean_?html|strip_?tags|striptags|purify|xss|filterXSS|encodeURIComponent|encodeURI|encode_?uri\w*|urlencode|safe_?header\w*", 0.55),
    ("proto_guard", r"\w*OwnProperty\w*|hasOwn|freeze|isPrototypeOf", 0.5),
    ("validation", r"_?validat\w*|\w+_validat\w*|is_?valid\w*|isValid\w*|check_(?!output\b|call\b)\w+|ensure_?(safe|valid|allowed|within)\w*|is_?safe\w*|isSafe\w*|is_?allowed\w*|isAllowed\w*|security_?checks?\w*|url_has_allowed_host_and_scheme|is_safe_url|sanity_?check\w*|assert_\w+", 0.45),
    ("safe_api", r"(?!safe_?load)safe_\w+|(?!safeLoad)safe[A-Z]\w*", 0.45),
)
AUTH_ATTRIBUTES = r"is_authenticated|is_staff|is_superuser|is_admin|isAdmin|isAuthenticated"
AUTH_WEIGHT = 0.6
REPLACE_CALLS, REPLACE_WEIGHT = r"replace|replaceAll|sub|gsub|translate|strip", 0.4
REPLACE_ARGUMENTS = r"\.\.|<|>|&(lt|gt|amp|quot|#)|\\x00|\\0|%00|\\r|\\n|javascript:|\\u0000|[\"']/[\"']"
# Kinds of guarding conditions, by condition and exit: kind, pattern, what it adds.
BLOCK_KINDS = (
    ("proto_guard", r"__proto__|\bconstructor\b|\bprototype\b|hasOwnProperty|hasOwn\b", 0.2),
    ("attr_guard", r"startswith\(\s*[\"']_|__(class|globals|builtins|subclasses|mro|base)__", 0.2),
    ("path_containment", r"\.\.|realpath|commonpath|commonprefix|is_relative_to|isabs|abspath|normpath|path\.sep|os\.sep|\bresolve\(|(?i:(path|dir|root|base|folder|file)\w*\.(startswith|startsWith)|(startswith|startsWith)\(\s*\w*(path|dir|root|base|folder))", 0.2),
    ("auth_check", r"perm|auth|login|logged|\brole|admin|owner|staff|superuser|csrf|is_active|access|forbidden|unauthori[sz]ed|\b40[13]\b|PermissionDenied|Forbidden|session|signature|hmac|digest|verify|token", 0.2),
    ("bounds_check", r"(\blen\(|\.length\b|\bsize\b|\bcount\b|MAX|max_|_max\b|limit|\bdepth\b)", 0.1),
    ("validation", r"isinstance|typeof|instanceof|\bre\.(match|search|fullmatch)|\.test\(|\.match\(|scheme|valid|safe|allow|whitelist|allowlist|blacklist|denylist|\bin\s+[A-Z_]{3,}|includes\(|indexOf|\btype\(", 0.1),
)
TAINTED = r"^(req|request|params?|query|body|input|user_?input|data|payload|path|file_?name|filename|file_?path|url|uri|href|link|host|hostname|domain|redirect\w*|next|target|dest\w*|cmd|command|args?|argv|key|name|value|headers?|cookies?|token|sql|template|expr\w*|src|source|content|html|text|user\w*|email|obj|options?|opts)$"
EXITS = {"raise": 0.55, "abort": 0.55, "return": 0.4, "continue": 0.3, "assert": 0.45}
MOST_BLOCK, MOST_BODY = 0.8, 4
ABORTS = r"abort|exit|_exit|fail|deny|forbid|reject|send_error|sendStatus|throw\w*|HttpResponseForbidden|HttpResponseBadRequest|HttpResponseNotFound|PermissionDenied"
LITERAL = r"None|False|True|null|undefined|false|true|-?\d+|''|\"\"|\[\]|\{\}|\(\)|NotImplemented"
ERRORISH = r"err|fail|forbid|denied|deny|invalid|unauthori|status|abort|reject|\b4\d\d\b|bad|block|not_?found|refuse|disallow|illegal|unsafe|insecure|redirect"
# Interfaces that are unsafe and their twins: group, kind, languages, hazard, twin, what makes a hazard its twin, weight alone, as a swap.
HAZARDS = (
    ("yaml_load", "safe_api", "pj", r"\byaml\.(load|load_all|unsafe_load|unsafe_load_all|full_load)\s*\(", r"\byaml\.(safe_load|safe_load_all|safeLoad|safeLoadAll)\s*\(", r"C?SafeLoader|JSON_SCHEMA|FAILSAFE_SCHEMA", 0.5, 0.9),
    ("pickle", "safe_api", "p", r"\b(c?[Pp]ickle|dill|cloudpickle|marshal|shelve|jsonpickle)\.(loads?|open|decode|Unpickler)\s*\(", r"\bjson\.loads?\s*\(", None, 0.5, 0.9),
    ("py_eval", "safe_api", "p", r"(?<![\w.])(eval|exec)\s*\(", r"\b(ast\.)?literal_eval\s*\(|\bjson\.loads?\s*\(", None, 0.5, 0.9),
    ("js_eval", "safe_api", "j", r"(?<![\w.])eval\s*\(|\bnew\s+Function\s*\(|\bvm\.(runInNewContext|runInThisContext|runInContext|compileFunction)\s*\(", r"\bJSON\.parse\s*\(", None, 0.5, 0.9),
    ("os_system", "shell", "p", r"\bos\.(system|popen)\s*\(|\b(commands|subprocess)\.(getoutput|getstatusoutput)\s*\(", r"\bsubprocess\.(run|call|check_call|check_output|Popen)\s*\(", None, 0.45, 0.85),
    ("child_exec", "shell", "j", r"(?<![\w$.])(exec|execSync)\s*\(|\b(child_process|childProcess|cp|shell|shelljs)\.(exec|execSync)\s*\(", r"\b(execFile|execFileSync|spawn|spawnSync)\s*\(", None, 0.45, 0.85),
    ("inner_html", "sanitiser", "j", r"\.(innerHTML|outerHTML)\s*(\+?=)(?!=)|\binsertAdjacentHTML\s*\(|\bdocument\.write(ln)?\s*\(|\bdangerouslySetInnerHTML\b", r"\.(textContent|innerText)\s*=(?!=)|\bcreateTextNode\s*\(", None, 0.45, 0.85),
    ("mark_safe", "sanitiser", "p", r"(?<![\w.])(mark_safe|Markup|SafeString|SafeText)\s*\((?!\s*[\"'][^\"'{}%]*[\"']\s*\))", r"(?<![\w.])(escape|conditional_escape|format_html)\s*\(", None, 0.4, 0.85),
    ("template_string", "safe_api", "p", r"\brender_template_string\s*\(|\.from_string\s*\(", r"\brender_template\s*\(", None, 0.35, 0.8),
    ("mktemp", "safe_api", "p", r"(?<![\w])(tempfile\.)?mktemp\s*\(", r"\b(tempfile\.)?(mkstemp|mkdtemp|NamedTemporaryFile|TemporaryFile|TemporaryDirectory)\s*\(", None, 0.3, 0.7),
    ("weak_hash", "weak_crypto", "pj", r"\bhashlib\.(md5|sha1)\s*\(|\bcreateHash\s*\(\s*[\"'](md5|sha1)[\"']", r"\bhashlib\.(sha256|sha384|sha512|sha3_\w+|blake2[bs]|pbkdf2_hmac|scrypt)\s*\(|\bcreateHash\s*\(\s*[\"']sha(256|384|512)[\"']|\b(bcrypt|argon2|scrypt)\b", None, 0.2, 0.7),
    ("weak_random", "weak_crypto", "pj", r"\brandom\.(random|randint|choice|choices|randrange|getrandbits)\s*\(|\bMath\.random\s*\(", r"\bsecrets\.\w+\s*\(|\bos\.urandom\s*\(|\bSystemRandom\b|\bcrypto\.(randomBytes|randomUUID|getRandomValues|randomInt)\s*\(", None, 0.0, 0.6),
    ("abspath", "path_containment", "p", r"\b(os\.path\.)?abspath\s*\(", r"\b(os\.path\.)?realpath\s*\(", None, 0.0, 0.7),
    ("send_file", "path_containment", "p", r"(?<![\w.])(flask\.)?send_file\s*\(", r"\bsend_from_directory\s*\(", None, 0.0, 0.7),
    ("xml_parse", "safe_api", "p", r"\b(xml\.etree\.\w+|minidom|pulldom|xml\.sax|expatbuilder)\.(parse|fromstring|XML|parseString|iterparse)\s*\(", r"\bdefusedxml\.\w+", None, 0.25, 0.8),
    ("unserialize", "safe_api", "j", r"(?<![\w$])(\w+\.)?unserialize\s*\(", r"\bJSON\.parse\s*\(", None, 0.5, 0.9),
    ("csrf_exempt", "auth_check", "p", r"\bcsrf_exempt\b", None, None, 0.5, 0.5),
)
# Flags: name, unsafe value, safe value (or the default is safe), kind, weight.
FLAGS = (
    ("shell", r"True|true|1", None, "shell", 0.8), ("verify|ssl_verify|verify_ssl|verify_certs?", r"False|false|0", None, "tls_verify", 0.8), ("check_hostname", r"False|false", None, "tls_verify", 0.8),
    ("rejectUnauthorized|strictSSL", r"false|0", None, "tls_verify", 0.8), ("insecure|insecureSkipVerify|InsecureSkipVerify", r"true|True", None, "tls_verify", 0.6), ("NODE_TLS_REJECT_UNAUTHORIZED", r"[\"']?0[\"']?", None, "tls_verify", 0.8),
    ("verify_signature|verify_exp|verify_aud|verify_iss", r"False|false", None, "auth_check", 0.7), ("ignoreExpiration|ignoreNotBefore", r"true", None, "auth_check", 0.6), ("autoescape|autoEscape", r"False|false", r"True|true|select_autoescape", "sanitiser", 0.7),
    ("noEscape", r"true", None, "sanitiser", 0.6), ("sanitize", r"false", None, "sanitiser", 0.5), ("resolve_entities|noent", r"True|true", r"False|false", "xxe", 0.6), ("load_dtd|huge_tree|dtd_validation", r"True|true", None, "xxe", 0.4),
    ("no_network", r"False|false", None, "xxe", 0.4), ("allow_pickle", r"True", None, "safe_api", 0.6), ("weights_only", r"False|false", r"True|true", "safe_api", 0.6), ("Loader", r"(yaml\.)?(Loader|UnsafeLoader|FullLoader)\b", r"(yaml\.)?C?SafeLoader", "safe_api", 0.7),
    ("allowProtoPropertiesByDefault|allowProtoMethodsByDefault|allowPrototypes", r"true", None, "proto_guard", 0.6), ("nodeIntegration", r"true", None, "safe_api", 0.6), ("contextIsolation|webSecurity|sandbox", r"false", None, "safe_api", 0.6),
    ("httponly|httpOnly|HttpOnly|secure", r"False|false", r"True|true", "cookie_flags", 0.35), ("allow_redirects|follow_redirects|followRedirects", r"True|true", r"False|false", "ssrf", 0.35),
)
SIGNATURE_WEIGHT, HELPER = 0.4, 0.4
SQL_WORDS = r"\b(select|insert\s+into|update|delete\s+from|where|from|values|order\s+by|group\s+by|join|set|limit|drop\s+table|create\s+table)\b"
SQL_UPPER = r"\b(SELECT|INSERT|UPDATE|DELETE|WHERE|FROM|VALUES|JOIN)\b"
SQL_CALLS = r"execute|executemany|executescript|exec_driver_sql|query|raw|rawQuery|text|prepare|all|run|get"
SQL_PLACES = r"%s|%\(\w+\)s|\?|(?<!:):\w+|\$\d+"
SQL_WEIGHT, SQL_SWAP = 0.6, 0.85
# Sensitive calls on added lines, by language: kind and pattern; how many of a kind and of a file.
PYTHON_SINKS = (
    ("command_exec", r"\bos\.(system|popen|exec\w*|spawn\w*)\s*\(|\bsubprocess\.\w+\s*\(|\bshell\s*=\s*True|\bcommands\.getoutput"),
    ("code_eval", r"(?<![\w.])(eval|exec)\s*\(|__import__\s*\(|\bimportlib\.import_module\s*\("),
    ("deserialization", r"\b(pickle|cPickle|dill|shelve|marshal|jsonpickle)\.(loads?|Unpickler)\b|\byaml\.(load|unsafe_load|full_load)\s*\(|\btorch\.load\s*\("),
    ("sql", r"\.(execute|executemany|executescript|raw)\s*\(\s*(f[\"']|[\"'][^\"']*[\"']\s*(%|\+|\.format))|\btext\s*\(\s*f[\"']|\.extra\s*\("),
    ("file_path", r"(?<![\w.])open\s*\(|\bsend_file\s*\(|\bsend_from_directory\s*\(|\bos\.path\.join\s*\(|\bshutil\.\w+\s*\(|\bFileResponse\s*\(|\.extractall\s*\(|\bos\.(remove|unlink|rename)\s*\("),
    ("redirect", r"\bredirect\s*\(|\bHttpResponseRedirect\s*\(|\bRedirectResponse\s*\("),
    ("outbound_request", r"\brequests\.(get|post|put|delete|head|patch|request)\s*\(|\burlopen\s*\(|\bhttpx\.(get|post|put|request|stream)\s*\(|\baiohttp\.ClientSession"),
    ("template", r"\brender_template_string\s*\(|\bmark_safe\s*\(|\bMarkup\s*\(|\|\s*safe\b|autoescape\s*=\s*False|\bjinja2\.Template\s*\("),
    ("crypto_tls", r"\bverify\s*=\s*False|\bCERT_NONE\b|_create_unverified_context|\bhashlib\.(md5|sha1)\s*\(|\brandom\.(random|randint|choice|getrandbits)\s*\("),
    ("auth", r"@csrf_exempt|\bAllowAny\b|permission_classes\s*=|\bjwt\.decode\s*\(|verify_signature"),
)
JAVASCRIPT_SINKS = (
    ("dom_xss", r"\.(innerHTML|outerHTML)\s*=|\binsertAdjacentHTML\s*\(|\bdocument\.write(ln)?\s*\(|dangerouslySetInnerHTML|\bv-html\b|\.html\s*\("),
    ("code_eval", r"(?<![\w.])eval\s*\(|\bnew\s+Function\s*\(|\bsetTimeout\s*\(\s*[\"'`]|\bvm\.\w+"),
    ("command_exec", r"\bchild_process\b|\b(exec|execSync|spawn|spawnSync|execFile|execFileSync)\s*\("),
    ("file_path", r"\bfs\.(promises\.)?\w+\s*\(|\bpath\.(join|resolve)\s*\(|\.(sendFile|download)\s*\(|\bcreateReadStream\s*\("),
    ("redirect", r"\.redirect\s*\(|\blocation(\.href)?\s*=|\blocation\.(assign|replace)\s*\("),
    ("outbound_request", r"(?<![\w.])fetch\s*\(|\baxios(\.\w+)?\s*\(|\bhttps?\.(get|request)\s*\(|\bgot\s*\("),
    ("sql", r"\.(query|raw|execute)\s*\(\s*(`[^`]*\$\{|[\"'][^\"']*[\"']\s*\+)|\bsequelize\.query\s*\("),
    ("deserialization", r"\b(unserialize|deserialize)\s*\(|\byaml\.load\s*\("),
    ("prototype", r"__proto__|constructor\.prototype|\b(merge|extend|defaultsDeep)\s*\("),
    ("crypto_tls", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED|\bMath\.random\s*\(|createHash\s*\(\s*[\"'](md5|sha1)"),
)
SINKS_PER_KIND, SINKS_PER_FILE = 3, 12

# ------------------------------------------------------------------------------------

SCHEMA = "id long, side string, family string, kind string, grp string, key string, polarity int, weight double, swap double, line int, names array<string>"
_CALLS = [(kind, re.compile(p, re.I), w) for kind, p, w in GUARD_CALLS]
_KINDS = [(kind, re.compile(p), w) for kind, p, w in BLOCK_KINDS]
_HAZARDS = [(g, k, langs, re.compile(bad), good and re.compile(good), unless and re.compile(unless), w, s) for g, k, langs, bad, good, unless, w, s in HAZARDS]
_FLAGS = [(re.compile(rf"(?<![\w.])[\"']?({name})[\"']?\s*(?:=(?!=)|:)\s*(?:(?P<bad>{bad})|(?P<good>{good or '(?!)'}))(?![\w.])"), name, kind, w) for name, bad, good, kind, w in FLAGS]
_SINKS = {"python": [(k, re.compile(p)) for k, p in PYTHON_SINKS], "javascript": [(k, re.compile(p)) for k, p in JAVASCRIPT_SINKS]}
_PY_TEXT = re.compile(r"#[^\n]*|[rRbBuUfF]{0,2}(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")", re.S)
_JS_TEXT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def masked(code: str, language: str) -> str:
    """Code with comments and texts of several words blanked; every character keeps its place."""

    def blank(m: re.Match) -> str:
        t = m[0]
        prose = t.startswith(("#", "//", "/*")) or len(t.split()) > 2
        return re.sub(r"[^\n]", " ", t) if prose else t

    return (_PY_TEXT if language == "python" else _JS_TEXT).sub(blank, code)


def shape(code: str, language: str) -> str:
    """Tokens of code with names that say nothing."""
    words = _JS_WORDS | {"def", "elif", "pass", "raise", "with", "lambda", "not", "and", "or", "is", "None", "True", "False", "assert", "from", "global", "except"}
    tokens = [m[0] for m in _JS_TOKEN.finditer(masked(code, language))]
    return " ".join("_" if _NAME.fullmatch(t) and t not in words else t for t in tokens if not t.isspace())


class _Unnamed(ast.NodeTransformer):
    """Takes names away, but for those of what is called and of fields."""

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return ast.copy_location(ast.Name("_", node.ctx), node)

    def visit_arg(self, node: ast.arg) -> ast.arg:
        return ast.copy_location(ast.arg("_"), node)

    def visit_Call(self, node: ast.Call) -> ast.Call:
        if isinstance(node.func, ast.Name):
            node.args, node.keywords = [self.visit(x) for x in node.args], [self.visit(x) for x in node.keywords]
            return node
        return self.generic_visit(node)


def outline(condition: str, language: str) -> str:
    """A condition without the names of variables, so that a new name makes it no other."""
    if language == "python":
        return ast.unparse(_Unnamed().visit(ast.parse(condition, mode="eval")))
    tokens = [m[0] for m in _JS_TOKEN.finditer(condition)]
    after, before = ["", *tokens], [*tokens[1:], ""]
    return " ".join("_" if _NAME.fullmatch(t) and t not in _JS_WORDS and a != "." and b != "(" else t for t, a, b in zip(tokens, after, before))


def _feature(family, kind, group, key, polarity, weight, swap, line, names=()):
    return family, kind, group, key, polarity, float(weight), float(swap), line, sorted(names)


def pattern_features(code: str, language: str) -> Iterator[tuple]:
    """Unsafe interfaces, their twins, and flags, on masked code."""
    text, short = masked(code, language), language[0]
    line = lambda m: text.count("\n", 0, m.start()) + 1
    for group, kind, languages, bad, good, unless, weight, swap in _HAZARDS:
        if short not in languages:
            continue
        for m in bad.finditer(text):
            call = text[m.start() : text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text)]
            if unless and unless.search(call):
                yield _feature("safe", kind, group, f"good:{group}:{m[0].strip()}", 1, 0, swap, line(m))
            else:
                yield _feature("hazard", kind, group, f"bad:{group}:{re.sub(chr(92) + 's+', '', m[0])}", -1, weight, swap, line(m))
        for m in good.finditer(text) if good else ():
            yield _feature("safe", kind, group, f"good:{group}:{re.sub(chr(92) + 's+', '', m[0])}", 1, 0, swap, line(m))
    signature = [(m.start(), m.end()) for m in re.finditer(r"\bdef\s+\w+\s*\([^)]*\)|\bfunction\s*\w*\s*\([^)]*\)|\([^()]*\)\s*=>", text)]
    for pattern, name, kind, weight in _FLAGS:
        for m in pattern.finditer(text):
            w = min(weight, SIGNATURE_WEIGHT) if any(a <= m.start() < b for a, b in signature) else weight
            if m["bad"] is not None:
                yield _feature("hazard", kind, f"flag:{name}", f"flag:{m[1]}:bad", -1, w, w, line(m))
            else:
                yield _feature("safe", kind, f"flag:{name}", f"flag:{m[1]}:good", 1, w, w, line(m))


def _call_kind(last: str) -> tuple[str, float] | None:
    return next(((kind, w) for kind, p, w in _CALLS if p.fullmatch(last)), None)


def _block(condition: str, exit_text: str, how: str, names: set[str], line: int, given: set[str], language: str) -> tuple:
    """A guard's feature: its kind by vocabulary, else an input check if it looks at an input or at what the function is given.

    One that is neither weighs nothing, and can only cancel one that was named otherwise.
    """
    found = next(((k, w) for k, p, w in _KINDS if p.search(condition) or p.search(exit_text)), None)
    if found is None and (names & given or any(re.match(TAINTED, n, re.I) for n in names)):
        found = ("input_check", 0.0)
    kind, weight = (found[0], min(MOST_BLOCK, EXITS[how] + found[1])) if found else (NO_KIND, 0.0)
    return _feature("block", kind, kind, f"{how}:{outline(condition, language)}", 1, weight, weight, line, names)


def _condition(guard: tuple | None, atoms: Iterator[tuple[str, int, set[str]]], language: str) -> Iterator[tuple]:
    """The features of a condition: its guard, and if that has no kind, its comparisons, of which bounds weigh."""
    if guard:
        yield guard
    if guard is None or guard[1] == NO_KIND:
        for text, line, names in atoms:
            kind, weight = ("bounds_check", conditions.BOUNDS_WEIGHT) if conditions.is_bound(text) else (NO_KIND, 0.0)
            yield _feature("cond", kind, kind, f"order:{outline(text, language)}", 1, weight, weight, line, names)


def _is_sql(text: str, callee: str) -> bool:
    """Two words of SQL, of which one is in capitals or all are given to a call that runs SQL."""
    words = {re.sub(r"\s+", " ", m[0].lower()) for m in re.finditer(SQL_WORDS, text, re.I)}
    return len(words) >= 2 and bool(re.search(SQL_UPPER, text) or re.fullmatch(SQL_CALLS, callee, re.I))


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id] if isinstance(node, ast.Name) else parts))


def _names(node: ast.AST) -> set[str]:
    return {x.id for x in ast.walk(node) if isinstance(x, ast.Name)}


def _python_exit(body: list[ast.stmt]) -> tuple[str, str] | None:
    """How a short body ends the flow, and the text of its end; logging may come before."""
    if not body or len(body) > MOST_BODY:
        return None
    logs = lambda x: isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) and conditions.writes_log(_name(x.value.func))
    last = next((x for x in body if not logs(x)), body[-1])
    text = ast.unparse(last)
    if isinstance(last, ast.Raise):
        return "raise", text
    if isinstance(last, ast.Continue | ast.Break):
        return "continue", text
    if isinstance(last, ast.Return):
        value = "" if last.value is None else ast.unparse(last.value)
        return ("return", text) if not value or re.fullmatch(LITERAL, value) or re.search(ERRORISH, value, re.I) else None
    if isinstance(last, ast.Expr) and isinstance(last.value, ast.Call):
        arguments = ", ".join(map(ast.unparse, last.value.args))
        if re.fullmatch(ABORTS, _name(last.value.func).rpartition(".")[2], re.I) or re.search(conditions.CLIENT_ERRORS, arguments):
            return "abort", text
    return None


def python_features(code: str) -> Iterator[tuple]:
    """(family, kind, group, key, polarity, weight, swap, line, names); nothing for code that can't be parsed."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    outer = next((n.args for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda)), None)
    given = {x.arg for x in ast.walk(outer) if isinstance(x, ast.arg)} if outer else set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            last = _name(node.func).rpartition(".")[2] or (node.func.attr if isinstance(node.func, ast.Attribute) else "")
            names = set().union(*[_names(a) for a in [*node.args, *[k.value for k in node.keywords]]])
            if last:
                yield _feature("callee", "callee", last, f"callee:{last}", 0, 0, 0, node.lineno, names)
            if guard := _call_kind(last):
                yield _feature("call", guard[0], guard[0], f"{guard[0]}:{last}", 1, guard[1], guard[1], node.lineno)
            elif re.fullmatch(REPLACE_CALLS, last) and re.search(REPLACE_ARGUMENTS, ", ".join(map(ast.unparse, node.args))):
                yield _feature("call", "sanitiser", "sanitiser", f"replace:{last}", 1, REPLACE_WEIGHT, REPLACE_WEIGHT, node.lineno)
            if node.args:
                first, rest = node.args[0], node.args[1:]
                text = ast.unparse(first)
                built = isinstance(first, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in first.values) or isinstance(first, ast.BinOp) or isinstance(first, ast.Call) and _name(first.func).endswith("format")
                if _is_sql(text, last):
                    if built:
                        yield _feature("hazard", "sql", "sql", "sql:built", -1, SQL_WEIGHT, SQL_SWAP, node.lineno)
                    elif rest and re.search(SQL_PLACES, text):
                        yield _feature("safe", "sql", "sql", "sql:bound", 1, 0, SQL_SWAP, node.lineno)
        elif isinstance(node, ast.Attribute) and id(node) not in called and re.fullmatch(AUTH_ATTRIBUTES, node.attr):
            yield _feature("call", "auth_check", "auth_check", f"auth_check:{node.attr}", 1, AUTH_WEIGHT, AUTH_WEIGHT, node.lineno)
        elif isinstance(node, ast.If):
            ends = _python_exit(node.body) or _python_exit(node.orelse)
            guard = _block(ast.unparse(node.test), ends[1], ends[0], _names(node.test), node.lineno, given, "python") if ends else None
            yield from _condition(guard, conditions.python_atoms(node.test), "python")
        elif isinstance(node, ast.Assert):
            yield _block(ast.unparse(node.test), "", "assert", _names(node.test), node.lineno, given, "python")
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            for d in node.decorator_list:
                last = _name(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2]
                if guard := _call_kind(last):
                    yield _feature("decorator", guard[0], last, f"@{last}", 1, guard[1], guard[1], d.lineno)
    yield from pattern_features(code, "python")


def javascript_features(code: str) -> Iterator[tuple]:
    """The same rows from JavaScript's tokens."""
    tokens, line, at = [], 1, 0
    for m in _JS_TOKEN.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(("//", "/*")):
            tokens.append((m[0], line, m.start(), m.end()))
    closing = {}
    for opener, closer in ("{}", "()"):
        stack = []
        for i, t in enumerate(tokens):
            if t[0] == opener:
                stack.append(i)
            elif t[0] == closer and stack:
                closing[stack.pop()] = i
    word = lambda i: tokens[i][0] if 0 <= i < len(tokens) else ""
    text = lambda a, b: code[tokens[a][2] : tokens[b][3]] if a <= b < len(tokens) else ""
    names = lambda a, b: {tokens[i][0] for i in range(a, min(b, len(tokens))) if _NAME.fullmatch(tokens[i][0]) and tokens[i][0] not in _JS_WORDS}

    def start(i: int) -> int:
        """Where the dotted name before a bracket begins."""
        while i and (word(i - 1) == "." or _NAME.fullmatch(word(i - 1)) and (word(i) in ".(")):
            i -= 1
        return i

    def body(i: int) -> tuple[int, int]:
        """Range of the tokens in a block, or of the one statement there."""
        if word(i) == "{":
            return i + 1, closing.get(i, len(tokens))
        return i, next((k for k in range(i, len(tokens)) if word(k) in (";", "}")), len(tokens))

    def exits(first: int, behind: int) -> tuple[str, str] | None:
        """How a short body ends the flow, and the text of its end."""
        parts = conditions.statements(tokens, first, behind)
        if not parts or len(parts) > MOST_BODY:
            return None
        a, b = next((p for p in parts if not conditions.writes_log(conditions.callee(tokens, *p))), parts[-1])
        end = text(a, b - 1)
        if word(a) in ("throw", "continue", "break"):
            return "raise" if word(a) == "throw" else "continue", end
        if word(a) == "return":
            value = text(a + 1, b - 1)
            return ("return", end) if not value or re.fullmatch(LITERAL, value) or re.search(ERRORISH, value, re.I) else None
        name = conditions.callee(tokens, a, b)
        if name and (re.fullmatch(ABORTS, name.rpartition(".")[2], re.I) or re.search(conditions.CLIENT_ERRORS, end)):
            return "abort", end
        return None

    opened = next((k for k in range(len(tokens)) if word(k) == "(" and (word(k - 1) == "function" or word(k - 2) == "function" or word(closing.get(k, -1) + 1) == "=>") and k in closing), None)
    given = names(opened + 1, closing[opened]) if opened is not None else set()
    for i in range(len(tokens)):
        if word(i) == "(" and i in closing and _NAME.fullmatch(word(i - 1) or " ") and word(i - 1) not in _JS_WORDS:
            last, inside = word(i - 1), text(i + 1, closing[i] - 1)
            yield _feature("callee", "callee", last, f"callee:{last}", 0, 0, 0, tokens[i][1], names(i + 1, closing[i]))
            if guard := _call_kind(last):
                yield _feature("call", guard[0], guard[0], f"{guard[0]}:{last}", 1, guard[1], guard[1], tokens[i][1])
            elif re.fullmatch(REPLACE_CALLS, last) and re.search(REPLACE_ARGUMENTS, inside):
                yield _feature("call", "sanitiser", "sanitiser", f"replace:{last}", 1, REPLACE_WEIGHT, REPLACE_WEIGHT, tokens[i][1])
            if conditions.callee(tokens, start(i), i + 1) in conditions.ASSERTIONS and inside:
                yield _block(inside, "", "assert", names(i + 1, closing[i]), tokens[i][1], given, "javascript")
            if _is_sql(inside, last):
                if "${" in inside or re.search(r"[\"']\s*\+", inside):
                    yield _feature("hazard", "sql", "sql", "sql:built", -1, SQL_WEIGHT, SQL_SWAP, tokens[i][1])
                elif re.search(SQL_PLACES, inside) and "," in inside:
                    yield _feature("safe", "sql", "sql", "sql:bound", 1, 0, SQL_SWAP, tokens[i][1])
        elif word(i) == "if" and word(i + 1) == "(" and i + 1 in closing:
            test, then = (i + 2, closing[i + 1]), body(closing[i + 1] + 1)
            otherwise = then[1] + (word(closing[i + 1] + 1) == "{" or word(then[1]) == ";")
            ends = exits(*then) or (exits(*body(otherwise + 1)) if word(otherwise) == "else" and word(otherwise + 1) != "if" else None)
            guard = _block(text(test[0], test[1] - 1), ends[1], ends[0], names(*test), tokens[i][1], given, "javascript") if ends else None
            yield from _condition(guard, conditions.javascript_atoms(tokens, *test, code), "javascript")
        elif re.fullmatch(AUTH_ATTRIBUTES, word(i) or " ") and word(i - 1) == "." and word(i + 1) != "(":
            yield _feature("call", "auth_check", "auth_check", f"auth_check:{word(i)}", 1, AUTH_WEIGHT, AUTH_WEIGHT, tokens[i][1])
    yield from pattern_features(code, "javascript")


# whole numbers that no rule tells from others as long, and stand-ins for them: a nine stands only at the front of one
_NUMBER = re.compile(r"(?<![\w.$%\\])[1-9][0-9]{3,16}(?![\w.])")
_STAND_INS = tuple("9" + "0" * 15 + a + b for a in "012345678" for b in "012345678")
# numbers in other forms, characters by name: these could turn into a stand-in, or a stand-in change what they are
_UNSURE = re.compile(r"0[xXoObB]|[0-9]_[0-9]|\\N|90{15}")


def numbered(*codes: str) -> tuple[tuple[str, ...], dict[str, str]]:
    """Codes with stand-ins for their numbers, equal ones for equal numbers, and the numbers by stand-in; as they are, where that is not safe."""
    if any(map(_UNSURE.search, codes)):
        return codes, {}
    names: dict[str, str] = {}
    try:
        out = tuple(_NUMBER.sub(lambda m: names.setdefault(m[0], _STAND_INS[len(names)]), c) for c in codes)
    except IndexError:  # more numbers than stand-ins
        return codes, {}
    return out, {s: n for n, s in names.items()}


def filled(text: str, numbers: dict[str, str]) -> str:
    """The text with its own numbers again."""
    for stand_in, number in numbers.items():
        text = text.replace(stand_in, number)
    return text


@lru_cache(maxsize=512)
def _read(code: str, language: str | None) -> tuple[tuple, ...]:
    """The features of a code; those of the last ones are remembered, as a version is the new side of one change and the old of the next."""
    find = {"python": python_features, "javascript": javascript_features}.get(language)
    return tuple(find(code)) if find else ()


def _without(rows: tuple[tuple, ...], other: tuple[tuple, ...]) -> list[tuple]:
    """What a side's features have more than the other's: of equal (family, key) the last by line, and callees that the other does not have."""
    have, out = Counter((f[0], f[3]) for f in other), []
    for f in sorted(rows, key=lambda f: f[7]):
        if not have[f[0], f[3]]:
            out.append(f)
        elif f[0] != "callee":
            have[f[0], f[3]] -= 1
    return out


@lru_cache(maxsize=4096)
def _read_pair(old: str, new: str, language: str | None, differing: bool) -> tuple[tuple, ...]:
    """(side, feature) of both sides, or of what differs between them."""
    a, b = _read(old, language), _read(new, language)
    if differing:
        a, b = _without(a, b), _without(b, a)
    return (*(("old", *f) for f in a), *(("new", *f) for f in b))


def _rows(old: str, new: str, language: str | None, differing: bool) -> Iterator[tuple]:
    codes, numbers = numbered(old, new)
    for row in _read_pair(*codes, language, differing):
        yield (*row[:4], filled(row[4], numbers), *row[5:]) if numbers else row


def features(rows: DataFrame, sides: tuple[str, str] = ("old", "new"), language: str | None = None, differing: bool = False) -> DataFrame:
    """rows (id, old, new[, language]) to one row per feature and side; Python where no language is named.

    differing: only what one side of a row has more than the other, which is all that is a change.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            named = batch[language] if language else ["python"] * len(batch)
            out = [(i, *f) for i, old, new, g in zip(batch["id"], batch[sides[0]], batch[sides[1]], named) for f in _rows(old or "", new or "", g, differing)]
            yield pd.DataFrame(out, columns=columns)

    return rows.select("id", *sides, *([language] if language else [])).mapInPandas(run, SCHEMA)


def changes(found: DataFrame) -> DataFrame:
    """Features to signed changes (id, family, kind, grp, direction, n, weight).

    They are written first: each side is read several times, and reading code is dear.
    """
    found = Scratch(found.sparkSession, "features").save(found, "found")
    keys = ["id", "family", "key"]
    sides = {side: found.filter(F.col("side") == side) for side in ("old", "new")}
    numbered = {side: occurrence(rows.filter("family <> 'callee'"), keys, ["line"]) for side, rows in sides.items()}
    # names that are passed to callees of one side alone: what moved into a helper is no full loss
    calls = {side: rows.filter("family = 'callee'").select("id", "grp", "names") for side, rows in sides.items()}

    def rest(side: str, other: str, sign: int) -> DataFrame:
        helped = calls[other].join(calls[side].select("id", "grp").distinct(), ["id", "grp"], "left_anti").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("helped"))
        alone = numbered[side].join(numbered[other], [*keys, "occurrence"], "left_anti").join(helped, "id", "left")
        moved = (F.col("family") == "block") & F.coalesce(F.arrays_overlap("names", "helped"), F.lit(False))
        return alone.withColumn("weight", F.when(moved, F.col("weight") * HELPER).otherwise(F.col("weight"))).drop("helped").withColumn("d", F.lit(sign))

    both = rest("old", "new", -1).unionByName(rest("new", "old", 1))
    net = both.groupBy("id", "family", "kind", "grp").agg(F.sum("d").alias("d"), F.max("weight").alias("weight"), F.max("swap").alias("swap")).filter("d <> 0")
    plain = net.filter("family not in ('hazard', 'safe') and weight > 0").select("id", "family", "kind", "grp", F.when(F.col("d") < 0, "removed").otherwise("added").alias("direction"), F.abs("d").alias("n"), "weight")
    h = net.filter("family = 'hazard'").select("id", "kind", "grp", F.col("d").alias("dh"), F.col("weight").alias("hw"), F.col("swap").alias("hs"))
    s = net.filter("family = 'safe'").select("id", "kind", "grp", F.col("d").alias("ds"), F.col("weight").alias("sw"), F.col("swap").alias("ss"))
    pair = h.join(s, ["id", "kind", "grp"], "full_outer").na.fill(0, ["dh", "ds"])
    dh, ds = F.col("dh"), F.col("ds")
    pair = pair.withColumn("swaps", F.when((dh > 0) & (ds < 0), F.least(dh, -ds)).when((dh < 0) & (ds > 0), -F.least(-dh, ds)).otherwise(0))
    swapped = pair.filter("swaps <> 0").select("id", F.lit("hazard").alias("family"), "kind", "grp", F.when(F.col("swaps") > 0, "weakened").otherwise("strengthened").alias("direction"), F.abs("swaps").alias("n"), F.coalesce("hs", "ss").alias("weight"))
    alone = pair.withColumn("left", dh - F.col("swaps")).filter("left <> 0 and hw > 0")
    alone = alone.select("id", F.lit("hazard").alias("family"), "kind", "grp", F.when(F.col("left") > 0, "weakened").otherwise("strengthened").alias("direction"), F.abs("left").alias("n"), F.col("hw").alias("weight"))
    # a safe setting that is dropped, or written, without an unsafe one on the other side
    lost = pair.withColumn("left", ds + F.col("swaps")).filter("left <> 0 and sw > 0")
    lost = lost.select("id", F.lit("safe").alias("family"), "kind", "grp", F.when(F.col("left") < 0, "weakened").otherwise("strengthened").alias("direction"), F.abs("left").alias("n"), F.col("sw").alias("weight"))
    return plain.unionByName(swapped).unionByName(alone).unionByName(lost)


def risk(changed: DataFrame) -> DataFrame:
    """Label per id: weakened or strengthened by at least 0.5 with a margin of 0.25; alert for one weakening of 0.7."""
    bad = F.col("direction").isin("removed", "weakened")
    amount = F.col("n") * F.col("weight")
    out = changed.groupBy("id").agg(
        F.round(F.sum(F.when(bad, amount).otherwise(0.0)), 3).alias("neg"), F.round(F.sum(F.when(bad, 0.0).otherwise(amount)), 3).alias("pos"),
        F.bool_or(bad & (F.col("weight") >= ALERT)).alias("strong"),
    )
    neg, pos = F.col("neg"), F.col("pos")
    label = F.when((neg >= LEAST) & (neg - pos >= MARGIN), "weakened").when((pos >= LEAST) & (pos - neg >= MARGIN), "strengthened").otherwise("none")
    return out.withColumn("risk", label).withColumn("alert", (F.col("risk") == "weakened") & F.col("strong")).drop("strong")


def evidence(units: DataFrame, language: str | None = None) -> DataFrame:
    """units (id, old, new[, language]) with risk, alert, their changes, and why there is no signal.

    A unit without code before it, or after it, is none that was weakened.
    """
    both = units.filter("coalesce(old, '') <> '' and new is not null")
    changed = changes(features(both, language=language, differing=True))
    rows = changed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("direction", "kind", "grp", "n", "weight"))).alias("changes"))  # of one unit
    out = units.join(risk(changed), "id", "left").join(rows, "id", "left")
    note = F.when(F.col("old").isNull(), "no_old_code").when((F.col("old") == "") & (F.col("new") != ""), "new_file").when(F.col("new").isNull(), "no_new_code")
    return out.withColumn("risk", F.coalesce("risk", F.lit("none"))).withColumn("alert", F.coalesce("alert", F.lit(False))).withColumn("note", note)


def alert_findings(found: DataFrame) -> DataFrame:
    """A row for each change of a unit with an alert that is itself one."""
    one = found.filter("alert").select("id", F.explode("changes").alias("c")).select("id", "c.*")
    return one.filter(F.col("direction").isin("removed", "weakened") & (F.col("weight") >= ALERT))


def both_ways(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """(id, fix_risk, rev_risk, rev_alert): the label of a pair and of the pair the other way round."""
    there = evidence(pairs.select("id", F.col(old).alias("old"), F.col(new).alias("new"))).select("id", F.col("risk").alias("fix_risk"), F.col("alert").alias("fix_alert"))
    back = evidence(pairs.select("id", F.col(new).alias("old"), F.col(old).alias("new"))).select("id", F.col("risk").alias("rev_risk"), F.col("alert").alias("rev_alert"))
    return there.join(back, "id")


def sinks(patch: str | None, language: str | None, per_kind: int = SINKS_PER_KIND, per_file: int = SINKS_PER_FILE) -> list[tuple[int, str]]:
    """(line, kind) of sensitive calls on added lines: of each line the first kind that is not yet at its cap."""
    rules = _SINKS.get(language or "") or [r for rs in _SINKS.values() for r in rs]
    out, seen = [], {}
    for _, tag, _, line, text in diff_rows(patch or ""):
        if tag != "+" or len(out) >= per_file:
            continue
        kind = next((k for k, p in rules if seen.get(k, 0) < per_kind and p.search(text)), None)
        if kind:
            seen[kind] = seen.get(kind, 0) + 1
            out.append((line, kind))
    return out


def with_sinks(files: DataFrame, patch: str = "patch", language: str = "language") -> DataFrame:
    """Adds `sinks`, array of (line, kind), of each file's patch."""

    @F.pandas_udf("array<struct<line:int,kind:string>>")
    def run(patches: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[{"line": a, "kind": k} for a, k in sinks(p, g)] for p, g in zip(patches, languages)])

    return files.withColumn("sinks", run(F.col(patch), F.col(language)))


def leads(files: DataFrame, hits: DataFrame, guards: DataFrame, floor: str = "high") -> DataFrame:
    """files (path, sinks) with counts of leads and their order: alerts, evidence, removed guards, any lead.

    hits (path, severity, low_confidence), guards (path, risk, alert, n_changes).
    """
    from palisade.functions.scalars import SEVERITY, lookup

    strong = F.coalesce(lookup(SEVERITY, F.lower("severity")), F.lit(0)) >= SEVERITY[floor]
    h = hits.groupBy("path").agg(F.count("*").alias("n_hits"), F.bool_or(strong & ~F.coalesce("low_confidence", F.lit(False))).alias("evidence"))
    g = guards.groupBy("path").agg(F.sum("n_changes").alias("n_changes"), F.bool_or("alert").alias("alert"), F.bool_or(F.col("risk") == "weakened").alias("weakened"))
    out = files.join(h, "path", "left").join(g, "path", "left").withColumn("n_sinks", F.size("sinks"))
    out = out.na.fill(0, ["n_hits", "n_changes"]).na.fill(False, ["evidence", "alert", "weakened"])
    return out.withColumn("priority", F.struct("alert", "evidence", "weakened", ((F.col("n_hits") > 0) | (F.col("n_sinks") > 0)).alias("any")))
