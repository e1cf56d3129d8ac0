"""Scalar columns: vectors, scores, intervals, text and identities. All stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring and severity rules.
HALF_LIFE_DAYS = 180
RECENCY_FLOOR, RECENCY_SPAN = 0.7, 0.3
SENIORITY = {"OWNER": 1.2, "MEMBER": 1.1, "COLLABORATOR": 1.05}
SUPPRESS_AT, DOWNWEIGHT, MULTIPLIER_FLOOR = -2, 0.15, 0.3
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
BUCKETS = 1 << 20


def lookup(values: dict, key: Column, default=None) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    # a shorter vector ends both
    return F.aggregate(F.filter(product, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 when a vector has no length; null when one is null."""
    of = norm(a) * norm(b)
    return F.when(of == 0, 0.0).otherwise(dot(a, b) / of)


def recency(days: Column) -> Column:
    return RECENCY_FLOOR + RECENCY_SPAN * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def vote_multiplier(net: Column) -> Column:
    """Votes never raise a score."""
    return F.greatest(F.lit(MULTIPLIER_FLOOR), 1 + DOWNWEIGHT * F.least(F.coalesce(net, F.lit(0)), F.lit(0)))


def logistic(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of a rate's interval; null where n is 0."""
    p, zz = F.try_divide(k, n), z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    real = n > 0
    return F.when(real, F.greatest(F.lit(0.0), middle - half)), F.when(real, F.least(F.lit(1.0), middle + half))


def precision_at(tpr: Column, fpr: Column, base: Column) -> Column:
    """Null when nothing would be flagged."""
    hit = base * tpr
    return F.try_divide(hit, hit + (1 - base) * fpr)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.0 * 1.25)


def canonical(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def identifiers(code: Column) -> Column:
    """Identifier tokens and the parts of snake_case ones, lower-cased."""
    lower = F.translate(code, string.ascii_uppercase, string.ascii_lowercase)
    names = F.regexp_extract_all(lower, F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    parts = F.flatten(F.transform(F.filter(names, lambda n: F.instr(n, "_") > 0), lambda n: F.filter(F.split(n, "_"), lambda p: p != "")))
    return F.when(F.instr(code, "_") > 0, F.concat(names, parts)).otherwise(names)


def bucket(token: Column) -> Column:
    return (F.crc32(token.cast("binary")) % BUCKETS).cast("int")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>])", r"\\$1")


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs) + 1, F.lit(0))))


def seeded(seed: int, *keys: Column) -> Column:
    """An order that is the same for any input order or partitioning."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *keys), 256)
