"""Scalar columns over text: severities, identities, neutralising, buckets, languages, dates.

All stay in the JVM. A null input gives null unless the function says otherwise; an empty
text is a text. Patterns are Java's, with ASCII classes; texts split at newlines only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import lookup

# --- fixed values -----------------------------------------------------------

# Lower ends of the severity bands of a score.
BANDS = (("critical", 9.0), ("high", 7.0), ("medium", 4.0))
# Weakness numbers to categories; the first entry that meets the given ones wins.
CATEGORIES = (
    (("89",), "sqli"), (("79", "80"), "xss"), (("77", "78", "94", "95"), "cmd_injection"), (("22", "23", "36"), "path_traversal"),
    (("798", "259", "321", "522"), "secrets"), (("918",), "ssrf"), (("611", "776"), "xxe"), (("502",), "deserialization"),
    (("327", "328", "326", "916"), "weak_crypto"), (("601",), "open_redirect"), (("862", "863", "639", "284"), "authz"),
    (("1321",), "prototype_pollution"), (("1333", "400"), "redos"),
)
# Metric values of the version 3 base score; PR depends on whether the scope changes.
CVSS_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
CVSS_AC = {"L": 0.77, "H": 0.44}
CVSS_UI = {"N": 0.85, "R": 0.62}
CVSS_CIA = {"N": 0.0, "L": 0.22, "H": 0.56}
CVSS_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
CVSS_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
# Invisible characters, controls and line breaks beyond the newline.
INVISIBLE = r"\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
BREAKS = r"\x{2028}\x{2029}"
BACKTICK, TILDE = "ˋ", "˜"
# Free-text reasons to buckets, the first that matches.
REASONS = (
    ("control_present", r"sanitiz|saniti[sz]|escap|validat|allowlist|whitelist|check(ed|s)? (before|for)|guard|normali[sz]"),
    ("not_attacker_controlled", r"not (user|attacker)[- ]controlled|trusted|internal|constant|hard[- ]?coded|not reachable from|no (user|external) input"),
    ("pre_existing", r"pre-?existing|already (present|there|existed)|not introduced|before (this|the) change"),
    ("unreachable", r"unreachable|dead code|never called|not reachable"),
    ("test_or_example", r"\btests?\b|example|fixture|mock"),
    ("insufficient_evidence", r"speculat|insufficient|cannot (confirm|determine)|unclear|no evidence|not enough"),
)
# Weaknesses and categories outside the scope, and those of timing and races.
DOS_CWES = (400, 405, 407, 409, 674, 770, 789, 799, 834, 835, 920, 1050, 1333)
DOS_CATEGORIES = ("redos",)
TIMING_CWES = (203, 208, 362, 367)
VOCABULARY = (
    "security", "vulnerab", "exploit", "attack", "malicious", "untrusted", "injection", "traversal", "sanitiz", "sanitis",
    "xss", "xxe", "csrf", "ssrf", "cve-", "ghsa-",
)
LANGUAGES = {
    "python": "python", "py": "python", ".py": "python", "javascript": "javascript", "js": "javascript", ".js": "javascript",
    "typescript": "javascript", "ts": "javascript", ".ts": "javascript", "jsx": "javascript", ".jsx": "javascript",
    "tsx": "javascript", ".tsx": "javascript", "mjs": "javascript", ".mjs": "javascript", "cjs": "javascript", ".cjs": "javascript",
}
EXTENSIONS = {".py": "python", ".js": "javascript", ".ts": "javascript"}
SKIPPED_PARTS, SKIPPED_STARTS = ("test", "spec", "__tests__", "fixtures"), ("docs/", "examples/")
PYTHON_HINT = r"(?m)^\s*(def |class |import |from \S+ import |async def )"
JAVASCRIPT_HINT = r"(?m)\bfunction\b|=>|\b(const|let|var)\s+\w+\s*=|\brequire\(|\bmodule\.exports\b|;\s*$"
LEVELS = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
YEAR_BINS = ("<=2022", "2023", "2024", "2025", "2026+")
VERDICTS = ("confirmed", "rejected", "uncertain")
COMMIT_URL = r"^https://github\.com/([^/\s]+)/([^/\s]+)/(?:commit|pull/\d+/commits)/([0-9a-fA-F]{7,40})(?:[/?#.].*)?$"
MESSAGE_CHARS, DESCRIPTION_CHARS = 200, 300


def first_match(cases: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first case that holds."""
    return reduce(lambda rest, c: F.when(c[1], F.lit(c[0])).otherwise(rest), reversed(cases), F.lit(default))


# --- severities and weaknesses ------------------------------------------------

def severity_band(score: Column) -> Column:
    return F.when(score.isNotNull(), first_match([(name, score >= low) for name, low in BANDS], "low"))


def category(cwes: Column) -> Column:
    """Category of an array of weakness ids; `other` if none is known, or there is no array."""
    numbers = F.transform(F.coalesce(cwes, F.array().cast("array<string>")), lambda c: F.trim(F.replace(F.upper(c), F.lit("CWE-"), F.lit(""))))
    return first_match([(name, F.coalesce(F.arrays_overlap(numbers, F.array(*map(F.lit, of))), F.lit(False))) for of, name in CATEGORIES], "other")


def cvss_base(vector: Column) -> Column:
    """Base score of a version 3 vector, rounded up to a tenth; null for another text or a missing metric."""
    pairs = F.filter(F.split(vector, "/"), lambda p: F.instr(p, ":") > 0)
    # the first part names the version; a metric that is given twice counts as the last one
    value = lambda m: F.regexp_extract(F.element_at(F.filter(pairs, lambda p: p.startswith(f"{m}:")), -1), ":(.*)$", 1)
    at = lambda table, m: lookup(table, F.when(F.size(F.filter(pairs, lambda p: p.startswith(f"{m}:"))) > 0, value(m)))
    changed = F.when(F.size(F.filter(pairs, lambda p: p.startswith("S:"))) > 0, value("S") == "C")
    c, i, a = (at(CVSS_CIA, m) for m in "CIA")
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    exploit = 8.22 * at(CVSS_AV, "AV") * at(CVSS_AC, "AC") * F.when(changed, at(CVSS_PR_CHANGED, "PR")).otherwise(at(CVSS_PR, "PR")) * at(CVSS_UI, "UI")
    base = F.least(F.when(changed, 1.08).otherwise(1.0) * (impact + exploit), F.lit(10.0))
    score = F.when(impact <= 0, 0.0).otherwise(F.ceil(base * 10) / 10.0)
    complete = changed.isNotNull() & impact.isNotNull() & exploit.isNotNull()
    return F.when(vector.startswith("CVSS:3") & complete, score)


def cvss_score(entries: Column) -> Column:
    """Score of an array of texts: the first that is a number (to a tenth) or a vector."""
    each = F.transform(entries, lambda x: F.coalesce(F.round(x.try_cast("double"), 1), cvss_base(x)))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def cwe_id(text: Column) -> Column:
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)CWE-?\s*(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number))


def cwe_ids(values: Column) -> Column:
    """Weakness ids named in an array of texts: upper-cased, each once, in order."""
    found = F.flatten(F.transform(values, lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"(?i)CWE-\d+"), F.lit(0)), F.upper)))
    return F.array_distinct(found)


def expected_cwes(values: Column) -> Column:
    """Normal form of an array of weakness texts, sorted; null for a null array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, cwe_id), lambda c: c.isNotNull())))


def cwe_number(text: Column) -> Column:
    return F.trim(F.replace(F.upper(text), F.lit("CWE-"), F.lit(""))).try_cast("int")


def scope(category_: Column, cwe: Column) -> Column:
    n = cwe_number(cwe)
    dos = F.coalesce(category_.isin(*DOS_CATEGORIES), F.lit(False)) | F.coalesce(n.isin(*DOS_CWES), F.lit(False))
    return F.when(dos, "dos").when(F.coalesce(n.isin(*TIMING_CWES), F.lit(False)), "timing_race").otherwise("in")


def rule_severity(level: Column, declared: Column) -> Column:
    """A rule's own severity if it declares one, else that of its level, else info."""
    own = F.lower(F.trim(declared))
    return F.when(own != "", own).otherwise(lookup(LEVELS, F.upper(level), "info"))


def short_rule(check: Column, known: Column) -> Column:
    """The longest dotted end of a check's id that is one of the known ids, else its last part."""
    parts = F.split(check, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.coalesce(F.get(F.filter(ends, lambda e: F.array_contains(known, e)), F.lit(0)), F.element_at(parts, -1))


def trimmed_message(text: Column, most: int = MESSAGE_CHARS) -> Column:
    """White space collapsed, at most so many characters, the last of them a mark of what is cut."""
    one = collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.left(one, F.lit(most - 1))), F.lit("…")))


# --- references and identities ------------------------------------------------

def commit_of(url: Column) -> Column:
    """Struct (owner, repo, sha) of a commit's address, else null."""
    url = F.trim(url)
    part = lambda i: F.regexp_extract(url, COMMIT_URL, i)
    return F.when(url.rlike(COMMIT_URL), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("sha")))


def fix_commit(references: Column, withdrawn: Column) -> Column:
    """commit_of the first usable reference (type, url), FIX before WEB; null for a withdrawn advisory."""
    usable = lambda kind: F.filter(references, lambda r: (r["type"] == kind) & commit_of(r["url"]).isNotNull())
    return F.when(withdrawn.isNull(), commit_of(F.get(F.concat(usable("FIX"), usable("WEB")), F.lit(0))["url"]))


def display_id(id_: Column, aliases: Column) -> Column:
    return F.coalesce(F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(0)), id_, F.lit("UNKNOWN"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def description(summary: Column, details: Column, most: int = DESCRIPTION_CHARS) -> Column:
    text = F.coalesce(F.when(summary != "", summary), details, F.lit(""))
    return F.left(collapsed(text), F.lit(most))


def item_kind(id_: Column, kind: Column, kinds: tuple[str, ...] = ("vulnerable", "fixed_twin", "handwritten", "ordinary")) -> Column:
    return F.when(kind.isin(*kinds), kind).when(id_.endswith("_vuln"), "vulnerable").when(id_.endswith("_safe"), "fixed_twin").otherwise("handwritten")


def inferred_kind(id_: Column, kind: Column, source: Column) -> Column:
    return F.when(kind != "", kind).when(source == "handwritten", "handwritten").when(id_.endswith("_vuln"), "vulnerable").when(id_.endswith("_safe"), "fixed_twin").otherwise("unknown")


def base_id(id_: Column, suffixes: str = "_misleading") -> Column:
    return F.regexp_replace(id_, f"({suffixes})$", "")


def pair_base(id_: Column) -> Column:
    return base_id(id_, "_vuln|_safe")


def benign_source(source: Column) -> Column:
    return F.when(source == "benign_commit", "real_commit").otherwise(F.coalesce(F.when(source != "", source), F.lit("unknown")))


def year_of(id_: Column) -> Column:
    return F.regexp_extract(F.coalesce(id_, F.lit("")), r"^CVE-(\d{4})-", 1).try_cast("int")


def year_bin(date: Column, bins: tuple[str, ...] = YEAR_BINS) -> Column:
    year = F.left(date, F.lit(4)).try_cast("int")
    year = F.when(date.rlike(r"^\d{4}"), year)
    fits = lambda b: year <= int(b[2:]) if b.startswith("<=") else year >= int(b[:-1]) if b.endswith("+") else year == int(b)
    return first_match([(b, F.coalesce(fits(b), F.lit(False))) for b in bins], "unknown")


def public_since(id_: Column, commits: Column, published: Column) -> Column:
    """Struct (since, source): the earliest of two arrays of ISO dates, else the year of the id."""
    least = lambda a: F.array_min(F.filter(a, lambda d: d != ""))
    commit, known = F.left(least(commits), F.lit(10)), F.left(F.least(least(commits), least(published)), F.lit(10))
    year = year_of(id_)
    since = F.coalesce(known, F.concat(year.cast("string"), F.lit("-01-01")))
    source = F.when(known.isNotNull(), F.when(F.coalesce(known == commit, F.lit(False)), "fix_commit").otherwise("osv_published")).when(year.isNotNull(), "cve_id_year").otherwise("unknown")
    return F.struct(since.alias("since"), source.alias("source"))


def moment(text: Column) -> Column:
    """An ISO text as a time, taken as UTC where it names no zone; null if it is none."""
    return F.try_to_timestamp(text)


def known_id(text: Column) -> Column:
    """An id, or null for the ways to write that there is none."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin("", "null", "none", "n/a"), trimmed)


# --- languages and paths --------------------------------------------------------

def language(name: Column) -> Column:
    return lookup(LANGUAGES, F.lower(F.trim(name)))


def extension(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1))
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")


def language_of(path: Column) -> Column:
    return lookup(EXTENSIONS, extension(path))


def guessed_language(code: Column) -> Column:
    return F.when(code.rlike(PYTHON_HINT), "python").when(code.rlike(JAVASCRIPT_HINT), "javascript")


def skipped_path(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in SKIPPED_PARTS] + [low.startswith(p) for p in SKIPPED_STARTS])


def code_file_count(files: Column) -> Column:
    """Files (filename) of a commit in a known language outside skipped paths; null without the commit."""
    return F.when(files.isNotNull(), F.size(F.filter(files, lambda f: language_of(f["filename"]).isNotNull() & ~skipped_path(f["filename"]))))


# --- text that is not trusted ---------------------------------------------------

def _visible(text: Column) -> Column:
    """Invisible characters, controls and further line breaks as [U+XXXX], character by character."""
    odd = f"[{INVISIBLE}{CONTROL}{BREAKS}]|\\r(?!\\n)"
    code = lambda c: F.concat(F.lit("[U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("]"))
    # a lone carriage return is told from one before a newline by what follows it
    chars = F.split(F.regexp_replace(text, "\\r(?!\\n)", " \r"), "")
    marked = F.transform(chars, lambda c, i: F.when(c == "\r", F.when(F.get(chars, i - 1) == " ", code(c)).otherwise(c)).when((c == " ") & (F.get(chars, i + 1) == "\r"), "").when(c.rlike(f"[{INVISIBLE}{CONTROL}{BREAKS}]"), code(c)).otherwise(c))
    return F.when(text.rlike(odd), F.array_join(marked, "")).otherwise(text)


def neutral(text: Column, most: int | None = None) -> Column:
    """Untrusted text without anything that hides, fences or closes; lines stay where they are.

    Nothing is deleted but by the cap, which cuts at a line's end in the second half and
    says how much is gone. A null is an empty text.
    """
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("<!--"), F.lit("&lt;!--"))
    out = _visible(out)
    look = lambda run, mark, to: F.array_join(F.transform(F.split(run, f"(?<=[{mark}])(?![{mark}])|(?<![{mark}])(?=[{mark}])"), lambda p: F.when(p.rlike(f"^[{mark}]{{3,}}$"), F.repeat(F.lit(to), F.length(p))).otherwise(p)), "")
    out = F.when(F.instr(out, "```") > 0, look(out, "`", BACKTICK)).otherwise(out)
    out = F.when(F.instr(out, "~~~") > 0, look(out, "~", TILDE)).otherwise(out)
    out = F.regexp_replace(out, r"(?i)<\s*(/?)\s*(untrusted)", "&lt;$1$2")
    if most is None:
        return out
    head = F.left(out, F.lit(most))
    at = F.length(head) - F.instr(F.reverse(head), "\n")  # characters before the last newline of the head
    cut = F.when((F.instr(head, "\n") > 0) & (at > most // 2), at).otherwise(most)
    note = F.concat(F.lit("\n[... truncated: "), (F.length(out) - cut).cast("string"), F.lit(" more characters not shown]"))
    return F.when(F.length(out) > most, F.concat(F.left(out, cut), note)).otherwise(out)


def label(value: Column, most: int = 160) -> Column:
    """One short line of harmless characters."""
    text = F.regexp_replace(neutral(value.cast("string")), r"[\r\n\t]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\w./\-+@:$#<>\[\] ]", "_")
    return F.left(F.translate(text, "<>", "‹›"), F.lit(most))


def cleaned(value: Column, most: int, code: bool = False) -> Column:
    """A field written by a model: no invisible characters or controls, trimmed, capped; prose without comments of markup."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = text if code else F.regexp_replace(text, "(?s)<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(text, f"[{INVISIBLE}{CONTROL}]", ""), r"^\s+|\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(most - 1)), r"\s+$", ""), F.lit("…")))


def code_span(text: Column) -> Column:
    """Inline code whose delimiter is longer than any run of backticks in it."""
    text = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", " "), F.lit("<!--"), F.lit("<! --"))
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    mark = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`") | (text == ""), " ").otherwise("")
    return F.concat(mark, pad, text, pad, mark)


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"([\\`*_\[\]()!#|~{}])", r"\\$1")
    return F.regexp_replace(text, r"(?<![\w`])@(?=[A-Za-z0-9])", "@​")


def inline(text: Column) -> Column:
    """Untrusted text as one line of inert markup: addresses as code, the rest escaped."""
    text = collapsed(F.coalesce(text, F.lit("")))
    url = r"(?:\b[a-zA-Z][a-zA-Z0-9+.\-]{1,15}://|\bwww\.)[^\s<>]+"
    between, links = F.split(text, url), F.regexp_extract_all(text, F.lit(url), F.lit(0))
    out = F.array_join(F.zip_with(F.transform(between, _escaped), F.transform(links, code_span), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(out, r"^([-+]|\d+\.)", r"\\$1")


def code_block(text: Column, indent: str = "") -> Column:
    """Array of lines of a fenced block; the fence is longer than any run of backticks."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("<!--"), F.lit("<! --"))
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    fence = F.concat(F.lit(indent), F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))
    return F.concat(F.array(fence), F.transform(lines, lambda x: F.concat(F.lit(indent), x)), F.array(fence))


# --- code as text -----------------------------------------------------------------

def canonical_code(code: Column, language_: Column) -> Column:
    """Code without comment lines, blank lines and white space, its lines joined by newlines."""
    text = F.when(language_ == "javascript", F.regexp_replace(code, r"(?s)/\*.*?\*/", "")).otherwise(code)
    lines = F.transform(F.split(text, r"\r?\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    comment = lambda x: ((language_ == "python") & x.startswith("#")) | ((language_ == "javascript") & x.startswith("//"))
    kept = F.filter(lines, lambda x: (x != "") & ~F.coalesce(comment(x), F.lit(False)))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+", "")), "\n")


def same_but_space(before: Column, after: Column, language_: Column) -> Column:
    return canonical_code(before, language_) == canonical_code(after, language_)


def body_hash(code: Column, language_: Column) -> Column:
    return F.sha2(canonical_code(code, language_), 256)


def line_count(code: Column) -> Column:
    return F.when(code == "", 0).otherwise(F.size(F.split(F.regexp_replace(code, r"\n$", ""), "\n")))


def pair_key(repo: Column, path: Column, name: Column, code: Column) -> Column:
    return F.concat_ws("|", repo, path, name, F.sha2(code, 256))


def vocabulary(lines: Column, terms: tuple[str, ...] = VOCABULARY) -> Column:
    """Sorted terms that stand in one of an array of lines, whatever their case."""
    low = F.transform(lines, F.lower)
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.exists(low, lambda x: F.contains(x, t))))


def anchors(touched: Column, n_lines: Column) -> Column:
    """Touched lines within a file of n lines, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(touched, lambda x: F.least(F.greatest(x, F.lit(1)), F.greatest(n_lines, F.lit(1))))))


# --- answers of a model -------------------------------------------------------------

def confidence(value: Column) -> Column:
    """1 to 10 from a number or text; a fraction below 1 is of ten, halves go up; null if it is no number."""
    x = value.cast("string").try_cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    rounded = F.floor(F.when((x > 0) & (x < 1), x * 10).otherwise(x) + 0.5)
    return F.when(x.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(1), rounded)).cast("int"))


def verdict(text: Column) -> Column:
    """One of the verdicts, whatever case and marks it is written with, else null."""
    word = F.lower(F.regexp_replace(text, r"^[\s.,;:!?*_`'\"]+|[\s.,;:!?*_`'\"]+$", ""))
    return F.when(word.isin(*VERDICTS), word)


def reason_bucket(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low == "", "no_reason").otherwise(first_match([(name, low.rlike(p)) for name, p in REASONS], "other"))


def error_class(daily: Column, bad_output: Column, last_outcomes: Column, statuses: Column) -> Column:
    """Class of a failed call from flags, its clients' last outcomes and, without those, the statuses of its events."""
    limited = F.when(last_outcomes.isNotNull(), F.array_contains(last_outcomes, "rate_limit")).otherwise(F.array_contains(statuses, 429))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return F.when(is_(daily), "daily_limit").when(is_(bad_output), "bad_output").when(is_(limited), "rate_limit").otherwise("other")


def anchor_line(exact: Column, start: Column, changed: Column, shown: Column) -> Column:
    """The diff line a comment goes to: the exact one, else the first changed one from it on, else the nearest."""
    nearest = lambda lines, to: F.element_at(F.array_sort(F.transform(lines, lambda x: F.struct(F.abs(x - to).alias("d"), x.alias("x")))), 1)["x"]
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    holds = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    want = F.coalesce(exact, start)
    after = F.filter(changed, lambda x: want.isNull() | (x >= want))
    return (
        F.when(holds(changed, exact) | holds(shown, exact), exact)
        .when(~some(changed), F.when(exact.isNotNull() & some(shown), nearest(shown, exact)))
        .when(some(after), F.array_min(after)).otherwise(nearest(changed, F.coalesce(want, F.get(changed, F.lit(0)))))
    )
