"""Queries over the driver's tables, by name, with the SQL that gives the same rows.

The mapping of the test tables to code-review data is stated with each group; doubles
are rounded to 6 places where sums may come in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.functions import exact
from palisade.functions import text as T
from palisade.operators import corpus as building
from palisade.operators import assembly, diffs, edits, evaluation, features, funnel, intervals, metrics, packing, removed, report, retrieval, sampling, sets, sides
from palisade.sources import builds, tables
from palisade.sources.scratch import Scratch
from palisade.streaming import jobs, live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- retrieval: queries are the vectors whose id is divisible by 20, the corpus is all vectors, and a vector does not
# match itself; a vector's fixed twin is the next one of its label; votes are events of the user with the vector's id;
# a vector's text is the document with its id

TWIN_MARGIN = -0.5
VOTES = {"click": 1, "purchase": 1, "error": -1}

_CORPUS_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
q AS (SELECT vec_id AS query_id, label AS query_label, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS point_id, label, list_cosine_similarity(qe, e) AS score, list_cosine_similarity(qe, f) - list_cosine_similarity(qe, e) AS margin
  FROM q, v WHERE vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s QUALIFY rank <= 10),
g AS (SELECT * FROM k WHERE score >= 0.0 AND (margin IS NULL OR margin >= -0.5)),
lv AS (SELECT user_id AS point_id, event_type, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS vote FROM events WHERE event_type IN ('click', 'purchase', 'error')
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
net AS (SELECT point_id, sum(vote)::BIGINT AS net FROM lv GROUP BY point_id),
fin AS (SELECT query_id, g.point_id, label, rank, score, margin, score * greatest(0.3, 1 + 0.15 * least(coalesce(net, 0), 0)) AS final FROM g LEFT JOIN net ON g.point_id = net.point_id WHERE coalesce(net, 0) > -2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank, point_id) AS place FROM fin QUALIFY place <= 3)
"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("vector"))


def _asked(points):
    return points.filter(F.col("point_id") % 20 == 0).select(F.col("point_id").alias("query_id"), "vector")


def _vectors(spark, sf_dir):
    v = _points(spark, sf_dir)
    # the ids alone are put in order, and vectors joined to them
    twin = v.select("point_id", F.lead("point_id").over(Window.partitionBy("label").orderBy("point_id")).alias("twin"))
    fixed = twin.join(v.select(F.col("point_id").alias("twin"), F.col("vector").alias("fixed")), "twin").select("point_id", "fixed")
    return _asked(v), v.join(fixed, "point_id", "left")


def _votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("vote", S.lookup(VOTES, F.col("event_type"))).filter("vote is not null")
    return retrieval.latest_votes(e.select(F.col("user_id").alias("point_id"), F.col("event_type").alias("finding_id"), "vote", "ts", F.col("event_id").alias("id")))


def _gated(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    top = retrieval.top_k(queries, corpus, own=False).filter(F.col("score") >= 0.0)
    return retrieval.passes_twin(retrieval.twin_margin(top, queries), TWIN_MARGIN)


@query(f"WITH {_CORPUS_SQL} SELECT query_id, point_id, rank, round(score, 6) AS score, round(margin, 6) AS twin_margin FROM k WHERE score >= 0.0 AND (margin IS NULL OR margin >= -0.5)")
def twin_topk(spark, sf_dir):
    return _gated(spark, sf_dir).select("query_id", "point_id", F.col("rank").cast("long"), r6(F.col("score"), "score"), r6(F.col("twin_margin"), "twin_margin"))


@query(f"WITH {_CORPUS_SQL} SELECT query_id, point_id, place, round(final, 6) AS final FROM top")
def finalize_matches(spark, sf_dir):
    return flagship(spark, sf_dir).select("query_id", "point_id", F.col("place").cast("long"), r6(F.col("final"), "final"))


def flagship(spark, sf_dir):
    return retrieval.finalize(_gated(spark, sf_dir).select("query_id", "point_id", "label", "rank", "score", "twin_margin"), _votes(spark, sf_dir))


@query(f"WITH {_CORPUS_SQL} SELECT label, query_id, point_id, round(final, 6) AS final FROM top QUALIFY row_number() OVER (PARTITION BY label ORDER BY final DESC, query_id, point_id) = 1")
def dedupe_best(spark, sf_dir):
    best = retrieval.best_per_key(flagship(spark, sf_dir), ["label"], [F.desc("final"), "query_id", "point_id"])
    return best.select("label", "query_id", "point_id", r6(F.col("final"), "final"))


@query(f"WITH {_CORPUS_SQL} SELECT point_id, net FROM net")
def net_votes(spark, sf_dir):
    return retrieval.net_votes(_votes(spark, sf_dir))


_TERMS = """n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)) AS names FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(list_concat(names, list_filter(flatten(list_transform(list_filter(names, lambda x: contains(x, '_')), lambda x: string_split(x, '_'))), lambda x: x <> ''))) AS term FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT term, ln(1 + ((SELECT count(DISTINCT doc_id) FROM t) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t GROUP BY term),
sp AS (SELECT a.doc_id AS query_id, b.doc_id AS point_id, round(sum(a.tf * b.tf * idf), 9) AS score FROM t a JOIN t b ON a.term = b.term JOIN i ON i.term = a.term
  WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL),
l2 AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sp QUALIFY rank <= 10)"""


def _sparse(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    queries, corpus = (retrieval.sparse_bags(t, "doc_id", "text") for t in (texts.filter("doc_id % 20 = 0"), texts))
    return retrieval.sparse_search(queries.withColumnRenamed("doc_id", "query_id"), corpus.withColumnRenamed("doc_id", "point_id"), own=False)


@query(f"WITH {_TERMS} SELECT query_id, point_id, rank, round(score, 6) AS score FROM l2")
def sparse_topk(spark, sf_dir):
    return _sparse(spark, sf_dir).select("query_id", "point_id", F.col("rank").cast("long"), r6(F.col("score"), "score"))


@query(f"""WITH {_CORPUS_SQL}, {_TERMS},
u AS (SELECT query_id, point_id, 1.0::DOUBLE / (2 + rank - 1) AS x FROM (SELECT query_id, point_id, rank FROM k UNION ALL SELECT query_id, point_id, rank FROM l2)),
f AS (SELECT query_id, point_id, round(sum(x), 6) AS fused, round(sum(x), 9) AS o FROM u GROUP BY ALL)
SELECT query_id, point_id, fused FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o DESC, point_id) <= 3""")
def hybrid_rrf(spark, sf_dir):
    corpus = _points(spark, sf_dir).select("point_id", "vector")
    dense = retrieval.top_k(_asked(corpus), corpus, own=False)
    return retrieval.reciprocal_rank_fusion([dense, _sparse(spark, sf_dir)]).select("query_id", "point_id", r6(F.col("fused"), "fused"))


@query(f"""WITH {_CORPUS_SQL}, b AS (SELECT query_id, label FROM k WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) = 1)
SELECT q.query_id AS id, b.label IS NOT NULL AS predicted, CASE WHEN b.label IS NOT NULL THEN b.label = query_label END AS category_hit FROM q LEFT JOIN b ON q.query_id = b.query_id""")
def category_hit(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    items = queries.select(F.col("query_id").alias("id")).join(corpus.select(F.col("point_id").alias("id"), F.col("label").alias("category")), "id")
    matches = retrieval.top_k(queries, corpus, own=False).select(F.col("query_id").alias("id"), "point_id", F.col("label").alias("category"), "score")
    return evaluation.category_hits(matches, items, 0.1).select("id", "predicted", "category_hit")


@query(f"""WITH {_CORPUS_SQL}, r AS (SELECT k.*, CASE WHEN point_id % 3 > 0 THEN 1 / (1 + exp(-((point_id % 7) - 3.0::DOUBLE))) END AS prob FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob DESC NULLS LAST, score DESC, rank) AS place FROM r QUALIFY place <= 5),
t AS (SELECT *, coalesce(prob, score) * (0.7 + 0.3 * pow(0.5, (point_id % 400) / 180.0)) * CASE point_id % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 WHEN 2 THEN 1.05 ELSE 1 END AS base FROM p WHERE prob IS NULL OR prob >= 0.2),
z AS (SELECT query_id, t.point_id, place, base * greatest(0.3, 1 + 0.15 * least(coalesce(net, 0), 0)) AS final FROM t LEFT JOIN net ON t.point_id = net.point_id WHERE coalesce(net, 0) > -2)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, place, point_id) AS place, round(final, 6) AS final FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final DESC, place, point_id) <= 3""")
def rerank_recency(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    top = retrieval.top_k(queries, corpus.select("point_id", "vector"), own=False).drop("vector")
    logits = top.filter("point_id % 3 > 0").select("query_id", "point_id", (F.col("point_id") % 7 - 3.0).alias("logit"))
    kept = retrieval.reranked(top, logits, 5)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    created = F.timestamp_seconds(F.unix_seconds(now) - (F.col("point_id") % 400) * 86400)
    of = F.element_at(F.array(*map(F.lit, ("OWNER", "MEMBER", "COLLABORATOR", "NONE"))), (F.col("point_id") % 4 + 1).cast("int"))
    out = retrieval.finalize(kept, _votes(spark, sf_dir), 3, retrieval.team_score(created, of, now), least=0.2)
    return out.select("query_id", "point_id", F.col("place").cast("long"), r6(F.col("final"), "final"))


@query("""SELECT t AS threshold, count(*) FILTER (lab AND p) AS tp, count(*) FILTER (NOT lab AND p) AS fp, count(*) FILTER (lab AND NOT p) AS fn, count(*) FILTER (NOT lab AND NOT p) AS tn
FROM (SELECT t, toxic = 1 AS lab, n_chars / 4000.0::DOUBLE >= t AS p FROM labels JOIN documents USING (doc_id), (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS t)) GROUP BY t""")
def threshold_sweep(spark, sf_dir):
    out = metrics.sweep(_scored(spark, sf_dir), [0.1, 0.25, 0.5, 1.0])
    return out.select("threshold", "tp", "fp", "fn", "tn")


# --- metrics: the label is toxic, the prediction a length rule; quality 0 in src0 is unscored

def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    pred = F.when((F.col("quality") == 0) & (F.col("source") == "src0"), None).otherwise(F.col("n_chars") > 1000)
    return d.select(F.col("doc_id").alias("id"), "lang", "source", "quality", (F.col("toxic") == 1).alias("label"), (F.col("n_chars") / 4000.0).alias("score"), pred.alias("pred"))


_SCORED = """m AS (SELECT doc_id AS id, lang, source, quality, toxic = 1 AS label, n_chars / 4000.0::DOUBLE AS score,
  CASE WHEN quality = 0 AND source = 'src0' THEN NULL ELSE n_chars > 1000 END AS pred FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (label AND pred) AS tp, count(*) FILTER (NOT label AND pred) AS fp, count(*) FILTER (label AND NOT pred) AS fn,
  count(*) FILTER (NOT label AND NOT pred) AS tn FROM m GROUP BY lang)
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), ["lang"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_SCORED}, c AS (SELECT source, count(*) FILTER (pred) AS k, count(pred) AS n FROM m GROUP BY source), p AS (SELECT *, k::DOUBLE / nullif(n, 0) AS rate FROM c)
SELECT source, k, n, round(rate, 6) AS rate,
  CASE WHEN n > 0 THEN round(greatest(0, (rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) END AS low,
  CASE WHEN n > 0 THEN round(least(1, (rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) END AS high FROM p""")
def rates_by_group(spark, sf_dir):
    return metrics.rates(_scored(spark, sf_dir), ["source"], "pred").withColumns({c: F.round(c, 6) for c in ("rate", "low", "high")})


@query(f"""WITH {_SCORED}, t AS (SELECT count(*) FILTER (label AND pred)::DOUBLE / count(*) FILTER (label AND pred IS NOT NULL) AS tpr,
  count(*) FILTER (NOT label AND pred)::DOUBLE / count(*) FILTER (NOT label AND pred IS NOT NULL) AS fpr FROM m)
SELECT base_rate, round(base_rate * tpr / (base_rate * tpr + (1 - base_rate) * fpr), 6) AS precision_at_base_rate FROM t, (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS base_rate)""")
def precision_at_base_rate(spark, sf_dir):
    m = _scored(spark, sf_dir)
    scored = F.col("pred").isNotNull()
    t = m.agg(
        (F.count_if(F.col("label") & F.col("pred")) / F.count_if(F.col("label") & scored)).alias("tpr"),
        (F.count_if(~F.col("label") & F.col("pred")) / F.count_if(~F.col("label") & scored)).alias("fpr"),
    )
    return metrics.base_rate_precision(F.col("tpr"), F.col("fpr"), t, [0.01, 0.02, 0.05]).select("base_rate", r6(F.col("precision_at_base_rate"), "precision_at_base_rate"))


@query(f"WITH {_SCORED} SELECT lang, source, grouping(lang)::BIGINT AS all_langs, grouping(source)::BIGINT AS all_sources, count(*) AS n, count(*) FILTER (pred) AS k FROM m GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def breakdown_grouping_sets(spark, sf_dir):
    m = _scored(spark, sf_dir)
    lang, source = F.col("lang"), F.col("source")
    out = m.groupingSets([[lang, source], [lang], [source], []], lang, source)
    return out.agg(F.grouping("lang").cast("long").alias("all_langs"), F.grouping("source").cast("long").alias("all_sources"), F.count("*").alias("n"), F.count_if("pred").alias("k"))


@query(f"WITH {_SCORED} SELECT lang, quality, count(*) AS n FROM m GROUP BY CUBE (lang, quality)")
def cube_counts(spark, sf_dir):
    return _scored(spark, sf_dir).cube("lang", "quality").agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORED}, b AS (SELECT a.id AS x, b.id AS y, a.pred AS a, b.pred AS b FROM (SELECT id, pred FROM m WHERE pred IS NOT NULL) a
  FULL JOIN (SELECT id, score > 0.3 AS pred FROM m WHERE lang <> 'de') b ON a.id = b.id)
SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither,
  count(*) FILTER (b IS NULL) AS missing_b, count(*) FILTER (a IS NULL) AS missing_a FROM b""")
def mcnemar_table(spark, sf_dir):
    m = _scored(spark, sf_dir)
    return metrics.paired(m.select("id", "pred"), m.filter("lang <> 'de'").select("id", (F.col("score") > 0.3).alias("pred")))


@query("""WITH o AS (SELECT o_custkey AS id, o_totalprice > 150000 AS pred FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3),
i AS (SELECT id, count(DISTINCT pred) AS kinds, count(pred) AS n FROM o GROUP BY id HAVING count(pred) = 3)
SELECT count(*) FILTER (kinds > 1) AS flips, count(*) AS items, round(count(*) FILTER (kinds > 1)::DOUBLE / count(*), 6) AS rate FROM i""")
def flip_rate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.withColumn("_n", F.row_number().over(first)).filter("_n <= 3").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") > 150000).alias("pred"))
    return metrics.flip_rate(rows, 3).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_SCORED} SELECT lang, count(*) FILTER (pred) AS k, count(*) FILTER (pred IS NULL) AS unknown, count(*) AS n, round(count(*) FILTER (pred)::DOUBLE / count(*), 6) AS low, round((count(*) FILTER (pred) + count(*) FILTER (pred IS NULL))::DOUBLE / count(*), 6) AS high FROM m GROUP BY lang")
def sensitivity_bounds(spark, sf_dir):
    return metrics.bounds(_scored(spark, sf_dir), ["lang"]).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, max(CASE WHEN i = ceil(0.5 * c) THEN value END) AS p50, max(CASE WHEN i = ceil(0.9 * c) THEN value END) AS p90 FROM p GROUP BY event_type""")
def nearest_rank_quantiles(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


# --- intervals: an order's ship dates are a closed span of days in its customer's file, order dates are points

_SPANS = """s AS (SELECT o_custkey AS k, o_orderkey AS pos, date_diff('day', DATE '1970-01-01', min(l_shipdate)::DATE) AS a, date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT o_custkey AS k, o_orderkey AS point, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders)"""


def _spans(spark, sf_dir):
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos")).agg(F.min(day("l_shipdate")).alias("a"), F.max(day("l_shipdate")).alias("b"))
    return s, o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point"), day("o_orderdate").alias("at"))


@query(f"WITH {_SPANS} SELECT point, pos, b - a AS length FROM p JOIN s ON p.k = s.k AND d BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY point ORDER BY b - a, pos) = 1")
def innermost_interval(spark, sf_dir):
    s, p = _spans(spark, sf_dir)
    return intervals.innermost(p, s, "k", ["point"], "at", "a", "b", "pos").select("point", "pos", (F.col("b") - F.col("a")).cast("long").alias("length"))


@query(f"WITH {_SPANS} SELECT point, pos, b - a AS length FROM p JOIN s ON p.k = s.k AND d BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY point ORDER BY b - a DESC, pos) = 1")
def outermost_interval(spark, sf_dir):
    s, p = _spans(spark, sf_dir)
    return intervals.innermost(p, s, "k", ["point"], "at", "a", "b", "pos", outermost=True).select("point", "pos", (F.col("b") - F.col("a")).cast("long").alias("length"))


@query(f"WITH {_SPANS} SELECT point, pos, abs(d - a) AS distance FROM p JOIN s ON p.k = s.k QUALIFY row_number() OVER (PARTITION BY point ORDER BY abs(d - a), pos) = 1")
def nearest_start(spark, sf_dir):
    s, p = _spans(spark, sf_dir)
    return intervals.nearest(p, s, ["k"], ["point"], "at", "a", "pos").select("point", "pos", F.abs(F.col("at") - F.col("a")).cast("long").alias("distance"))


@query(f"""WITH {_SPANS}, f AS (SELECT point, string_agg(DISTINCT pos::VARCHAR, ',' ORDER BY pos::VARCHAR) AS sources FROM p JOIN s ON p.k = s.k AND abs(d - a) <= 3 GROUP BY point)
SELECT p.point, sources FROM p LEFT JOIN f ON p.point = f.point""")
def corroborate(spark, sf_dir):
    s, p = _spans(spark, sf_dir)
    return intervals.corroborated(p, s.withColumn("source", F.col("pos").cast("string")), "k", "point", "at", "a", "source").select("point", "sources")


# --- funnels: documents as candidates

@query("""SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN contains(text, 'Licensed under') THEN 'license' END AS first_reason,
array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'too_short' END, CASE WHEN n_chars > 8000 THEN 'too_long' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END,
  CASE WHEN contains(text, 'Licensed under') THEN 'license' END], lambda x: x IS NOT NULL), ',') AS all_reasons FROM documents""")
def reject_reasons(spark, sf_dir):
    checks = [("too_short", F.col("n_chars") < 100), ("too_long", F.col("n_chars") > 8000), ("language", ~F.col("lang").isin("en", "de")), ("license", F.contains("text", F.lit("Licensed under")))]
    return table(spark, sf_dir, "documents").select("doc_id", funnel.first_reason(checks).alias("first_reason"), F.array_join(funnel.all_reasons(checks), ",").alias("all_reasons"))


_CANDIDATES = """c AS (SELECT event_id AS id, user_id AS scan, event_type AS unit, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 10 + 1 END AS confidence, hour(ts) AS line, CASE WHEN event_id % 13 = 0 THEN 'tests' END AS exclusion,
  CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' END AS verdict FROM events)"""


def _candidates(spark, sf_dir):
    i = F.col("event_id")
    severity = F.element_at(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("scan"), F.col("event_type").alias("unit"), severity.alias("severity"), F.when(i % 11 != 0, i % 10 + 1).alias("confidence"),
        F.hour("ts").alias("line"), F.when(i % 13 == 0, "tests").alias("exclusion"), F.when(i % 3 == 0, "confirmed").when(i % 3 == 1, "rejected").alias("verdict"),
    )


@query(f"""WITH {_CANDIDATES}, r AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS sr, coalesce(confidence, 5) AS cf FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY scan, unit, line ORDER BY sr DESC, cf DESC, id) > 1 AS copy FROM r),
o AS (SELECT *, NOT copy AND exclusion IS NULL AND cf >= 5 AS open FROM d), p AS (SELECT *, row_number() OVER (PARTITION BY scan, open ORDER BY sr DESC, cf DESC, id) AS place FROM o)
SELECT id, CASE WHEN copy THEN 'duplicate' WHEN exclusion IS NOT NULL THEN 'excluded' WHEN cf < 5 THEN 'below_floor' WHEN place > 8 THEN 'over_cap' WHEN verdict IS NULL THEN 'not_verified'
  WHEN verdict = 'confirmed' AND cf >= 7 THEN 'confirmed' WHEN verdict = 'confirmed' THEN 'low_confidence' ELSE 'rejected' END AS status FROM p""")
def funnel_partition(spark, sf_dir):
    return funnel.funnel(_candidates(spark, sf_dir), "scan", ["unit", "line"]).select("id", "status")


@query(f"WITH {_CANDIDATES} SELECT scan, bool_or(severity = 'critical') AS fails FROM c GROUP BY scan")
def severity_gate(spark, sf_dir):
    return funnel.gate(_candidates(spark, sf_dir), ["scan"], "critical")


@query("""WITH u AS (SELECT user_id AS scan, CASE WHEN event_type IN ('click', 'view') THEN 'reviewed' WHEN event_type = 'error' THEN 'partial' ELSE 'left' END AS state FROM events)
SELECT scan, count(*) AS total, count(*) FILTER (state = 'reviewed') AS reviewed, count(*) FILTER (state = 'partial') AS "partial",
  CASE WHEN count(*) FILTER (state <> 'left') = 0 THEN 'failed' WHEN count(*) FILTER (state = 'reviewed') < count(*) THEN 'partial' ELSE 'complete' END AS status FROM u GROUP BY scan""")
def coverage_status(spark, sf_dir):
    state = F.when(F.col("event_type").isin("click", "view"), "reviewed").when(F.col("event_type") == "error", "partial").otherwise("left")
    return funnel.coverage(table(spark, sf_dir, "events").select(F.col("user_id").alias("scan"), state.alias("state")), "scan")


@query("""WITH h AS (SELECT event_id, user_id::VARCHAR || ':' || event_type AS marker, round(value, 2) AS body, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type <> 'signup'),
w AS (SELECT user_id::VARCHAR || ':' || event_type AS marker, round(min(value), 2) AS body FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT coalesce(h.marker, w.marker) AS marker, event_id AS comment_id, CASE WHEN w.marker IS NULL OR n > 1 THEN 'delete' WHEN event_id IS NULL THEN 'create' WHEN h.body = w.body THEN 'keep' ELSE 'update' END AS op
FROM h FULL JOIN w ON h.marker = w.marker""")
def comment_ops(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("marker", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    existing = e.filter("event_type <> 'signup'").select(F.col("event_id").alias("comment_id"), "marker", F.round("value", 2).alias("body"))
    return funnel.comment_plan(existing, e.filter("event_type <> 'error'").groupBy("marker").agg(F.round(F.min("value"), 2).alias("body")))


# --- sets: features of an order are its lines, old and new by ship year

@query("""WITH a AS (SELECT l_suppkey AS s, l_returnflag AS f, l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT l_suppkey AS s, l_returnflag AS f, count(*) AS c FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT a.s AS l_suppkey, a.f AS l_returnflag, o AS l_orderkey, n AS l_linenumber FROM a LEFT JOIN b ON a.s = b.s AND a.f = b.f WHERE i > coalesce(c, 0)""")
def multiset_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus")
    return sets.multiset_minus(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber"]).drop("l_linestatus").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, sum(CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END)::BIGINT AS net FROM lineitem GROUP BY l_partkey HAVING sum(CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END) <> 0")
def net_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus")
    return sets.net_counts(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus <> 'F'"), ["l_partkey"])


@query(r"SELECT sha256(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) AS body, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def body_hash_dupes(spark, sf_dir):
    body = F.sha2(S.canonical(F.col("text")), 256)
    return table(spark, sf_dir, "documents").groupBy(body.alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def _doc_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("id"), F.array_distinct(F.array_remove(F.split(F.col("text"), r"[ \n]+"), "")).alias("tokens"))


_DOC_LINKS = r"""t AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> ''))) AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS class_id FROM t),
s AS (SELECT id, len(w) AS n, w FROM c WHERE len(w) >= 5 AND id = class_id), x AS (SELECT id, n, unnest(w) AS k FROM s),
l AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c FROM x p JOIN x q ON p.k = q.k AND p.id < q.id
  AND least(p.n, q.n) >= 0.7 * greatest(p.n, q.n) GROUP BY p.id, q.id) WHERE c::DOUBLE / (na + nb - c) >= 0.7)"""


@query(f"""WITH {_DOC_LINKS}, e AS (SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM l UNION ALL SELECT b FROM l) GROUP BY id)
SELECT c.id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN e ON e.id = class_id""")
def near_dups(spark, sf_dir):
    member, links = sets.near_duplicate_classes(_doc_tokens(spark, sf_dir))
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return member.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(f"""WITH RECURSIVE {_DOC_LINKS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, g) AS (SELECT id, id FROM c WHERE id = class_id UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(g) AS component FROM r GROUP BY id)
SELECT c.id, component FROM c JOIN m ON m.id = class_id""")
def components(spark, sf_dir):
    member, links = sets.near_duplicate_classes(_doc_tokens(spark, sf_dir))
    heads = sets.components(member.select(F.col("class_id").alias("id")), links.select("a", "b"))
    return member.join(heads.withColumnRenamed("id", "class_id"), "class_id").select("id", "component")


@query("SELECT md5(text) AS key, count(DISTINCT source) AS sides, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def leak_check(spark, sf_dir):
    return sets.leaks(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "source"), "key", "source")


# --- sampling

@query("""WITH g AS (SELECT DISTINCT c_nationkey AS g FROM customer), o AS (SELECT g, row_number() OVER (ORDER BY sha256('7:' || g), g) AS i FROM g), n AS (SELECT round_even(count(*) * 0.15, 0) AS take FROM g)
SELECT c_custkey, i <= take AS held_out FROM customer JOIN o ON g = c_nationkey, n""")
def group_holdout(spark, sf_dir):
    return sampling.group_holdout(table(spark, sf_dir, "customer"), "c_nationkey", 0.15, 7).select("c_custkey", "held_out")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || lang || ':' || doc_id), doc_id) <= 25")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents"), ["lang"], "doc_id", 25, 3).select("lang", "doc_id")


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id), doc_id) AS t FROM documents)
SELECT source, doc_id FROM d WHERE t <= 25 ORDER BY t, sha256('5:' || source), source LIMIT 150""")
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents"), "source", "doc_id", 150, 25, 5).select("source", "doc_id")


@query("""WITH p AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), s AS (SELECT lang, size, size * 97 / sum(size) OVER ()::DOUBLE AS share FROM p),
i AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS i, 97 - sum(floor(share)) OVER () AS l FROM s)
SELECT lang, size, (floor(share) + CASE WHEN i <= l THEN 1 ELSE 0 END)::BIGINT AS quota FROM i""")
def largest_remainder(spark, sf_dir):
    return sampling.largest_remainder(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("size")), "lang", "size", 97)


#: Orders by status are fixes, flaws and ordinary commits, customers are repositories; a quarter of them is for tests.
@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS id, 'r' || o_custkey AS repo, CASE WHEN o_custkey % 4 = 0 THEN 'test' ELSE 'dev' END AS side, CASE o_orderstatus WHEN 'F' THEN 'vuln_fix' WHEN 'O' THEN 'vuln_introducing' ELSE 'benign' END AS kind, o_orderpriority AS language FROM orders),
offered AS (SELECT * FROM o WHERE kind = 'benign' AND side = 'dev' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY sha256('9:' || id), id) <= 2),
pools AS (SELECT language, count(*) AS size FROM offered GROUP BY 1), mix AS (SELECT language, count(*) AS weight FROM o WHERE kind = 'vuln_introducing' AND side = 'dev' GROUP BY 1),
shares AS (SELECT language, size, weight * 20 / sum(weight) OVER ()::DOUBLE AS share FROM pools JOIN mix USING (language)),
quotas AS (SELECT language, least(floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, language) <= 20 - sum(floor(share)) OVER () THEN 1 ELSE 0 END, size) AS quota FROM shares),
dealt AS (SELECT *, row_number() OVER (PARTITION BY language, repo ORDER BY sha256('9:' || id), id) AS turn, sha256('9:' || language || ':' || repo) AS h FROM offered),
placed AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY turn, h, repo) AS place FROM dealt),
sample AS (SELECT id FROM placed JOIN quotas USING (language) ORDER BY place > quota, turn, h, repo, language LIMIT 20)
SELECT side AS split, id, repo, kind FROM o WHERE side = 'test' OR kind <> 'benign' OR id IN (FROM sample)""")
def checked_split(spark, sf_dir):
    side = lambda c: F.when(F.col(c) % 4 == 0, "test").otherwise("dev").alias("side")
    id_, repo, commit = F.col("o_orderkey").cast("string"), F.concat(F.lit("r"), "o_custkey"), F.concat(F.lit("c"), "o_orderkey")
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kind = F.when(F.col("o_orderstatus") == "F", "vuln_fix").when(F.col("o_orderstatus") == "O", "vuln_introducing")
    told = o.select(id_.alias("id"), repo.alias("repo"), side("o_custkey"), kind.alias("kind"), commit.alias("commit"), F.concat(F.lit("a"), "o_custkey").alias("advisory"), F.col("o_orderpriority").alias("language"), F.col("o_orderpriority").alias("title"))
    bystanders = c.select(F.concat(F.lit("b"), "c_custkey").alias("id"), F.concat(F.lit("r"), "c_custkey").alias("repo"), side("c_custkey"), F.lit("benign").alias("kind"))
    items = told.filter("kind is not null").unionByName(bystanders, allowMissingColumns=True).withColumn("sampled", F.lit(True))
    commits = told.filter("kind is null").select("id", "repo", "commit", "language", "title")
    folder = Scratch(spark, "checked_split").root
    assembly.build(folder, items, commits, spark.createDataFrame([], "commit string"), 20, 9)
    held = builds.read(spark, folder, verify=False)
    return held["dev"].unionByName(held["test"]).select(F.col("side").alias("split"), "id", "repo", "kind")


# --- streams and stores

@query("SELECT user_id, event_type AS finding, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS vote FROM events WHERE event_type IN ('click', 'purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_vote(spark, sf_dir):
    return _votes(spark, sf_dir).select(F.col("point_id").alias("user_id"), F.col("finding_id").alias("finding"), "vote")


@query("""WITH e AS (SELECT user_id AS job, ts, event_id AS id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state FROM events)
SELECT job, state FROM e WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY CASE state WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END DESC, ts, id) = 1""")
def job_states(spark, sf_dir):
    states = {"signup": "queued", "view": "running", "purchase": "completed", "error": "failed"}
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), S.lookup(states, F.col("event_type")).alias("state"), "ts", F.col("event_id").alias("id"))
    return jobs.latest_state(e).select("job", "state")


@query(ORACLES["job_states"])
def live_job_states(spark, sf_dir):
    """As job_states, by a stream with state that is stopped and started again on its checkpoint."""
    states = {"signup": "queued", "view": "running", "purchase": "completed", "error": "failed"}
    scratch = Scratch(spark, "live")
    put = jobs.upsert_buckets(f"{scratch.root}/out", "job", ["epoch"], 16)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), S.lookup(states, F.col("event_type")).alias("state"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    for start in (0, 1):  # the second takes up what the first has left
        e.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == start).write.mode("append").parquet(f"{scratch.root}/in")
        changes = live.job_states(spark.readStream.schema(e.schema).parquet(f"{scratch.root}/in"), delay="1000 days")
        to = changes.writeStream.foreachBatch(lambda batch, epoch: put(batch.withColumn("epoch", F.lit(epoch)), epoch))
        to.option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_buckets(spark, f"{scratch.root}/out", changes.schema.simpleString()[7:-1].replace(":", " ")).select("job", "state")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), 4) AS load FROM (SELECT event_id, event_type, value, date_trunc('second', ts) AS ts FROM events)")
def sliding_budget(spark, sf_dir):
    return jobs.sliding_load(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value").select("event_id", F.round("load", 4).alias("load"))


@query("""WITH c AS (SELECT user_id AS key, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT o_orderkey, value, CASE WHEN value IS NULL THEN 'not_run' ELSE 'cached' END AS status FROM orders LEFT JOIN c ON key = o_custkey""")
def replay_cache(spark, sf_dir):
    cache = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("written"))
    return jobs.read_through(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), cache, "key").select("o_orderkey", "value", "status")


@query("SELECT user_id AS repo, max(event_id) AS last_pr, max(ts) AS run_at FROM events GROUP BY 1")
def cursor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("last_pr"), F.col("ts").alias("run_at"))
    return tables.advance_cursor(e.filter("last_pr % 2 = 0"), e.filter("last_pr % 2 = 1"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.windowed_counts(e, "ts", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


# --- text

@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]*)").alias("host"), part("://[^/?#]*([^?#]*)").alias("path"), part("[?]([^#]*)").alias("query"))


@query(r"SELECT doc_id, ceil(length(text) / 4.0 * 1.25)::BIGINT AS tokens, left(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), 300) AS short FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.token_estimate(F.col("text")).cast("long").alias("tokens"), F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(300)).alias("short"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY conv_id HAVING sum(length(text)) >= 80")
def conversation_docs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id")
    out = c.agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("n"))
    return out.filter("n >= 80").select("conv_id", F.array_join(F.col("t.text"), "\n").alias("body"), "turns")


@query("SELECT doc_id, 'doc:' || left(sha1(doc_id || '|' || lang || '|' || source), 16) AS identity FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.content_id("doc", F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("identity"))


# --- diffs, features and packing: checked by invariants in the tests

@query()
def diff_lines(spark, sf_dir):
    return diffs.with_patch(_neighbours(spark, sf_dir)).select("doc_id", "diff.added", "diff.removed", "diff.round_trip", F.size(diffs.added_lines(F.col("diff.patch"))).alias("added_lines"))


def _neighbours(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # documents that are near in size and stand next to each other in a source and its bin of a hundred ids: texts are dealt out once
    w = Window.partitionBy("source", F.floor(F.col("doc_id") / 100)).orderBy("doc_id")
    return d.select("doc_id", F.lag("doc_id").over(w).alias("old_id"), F.col("text").alias("new"), F.lag("text").over(w).alias("old")).filter("old_id is not null")


@query()
def removed_evidence(spark, sf_dir):
    """Every removed line is a change of the document's one unit, the first touched line a candidate; lines with a digit are alerts."""
    files = diffs.with_patch(_neighbours(spark, sf_dir)).select(F.col("doc_id").alias("scan"), F.lit("text").alias("path"), "new", "diff.patch", "diff.touched")
    files = Scratch(spark, "removed").save(files, "files", compression="zstd")
    lines = removed.diff_rows(files)
    changes = lines.filter("tag = '-'").select(
        "scan", F.col("old_line").alias("change"), "path", F.lit(1).alias("start_line"), F.lit(1 << 30).alias("end_line"), F.lit("removed").alias("direction"), F.col("text").alias("old_text"),
        F.lit(None).cast("int").alias("line"), F.col("text").rlike("[0-9]").alias("alert"),
    )
    candidates = files.filter("size(touched) > 0").select("scan", F.lit(0).alias("id"), "path", F.col("touched")[0].alias("line"), F.lit(None).cast("int").alias("end_line"))
    nowhere = spark.createDataFrame([], "scan long, path string, start_line int, end_line int, old_start int, old_end int")
    return removed.removal_checks(candidates, changes, files, nowhere)


#: Shapes of a change: language, code before, code after.
SHAPES = (
    ("python", "def f(u, x):\n    if not u.is_admin:\n        raise PermissionError\n    return yaml.safe_load(x)\n", "def f(u, x):\n    return yaml.load(x)\n"),
    ("python", "def f(x):\n    return eval(x)\n", "def f(x):\n    return ast.literal_eval(x)\n"),
    ("python", "def f(x):\n    return x + 1\n", "def f(y):\n    log(y)\n    return y + 1\n"),
    ("python", "def f(c, i):\n    c.execute('SELECT a FROM t WHERE id = %s', (i,))\n", "def f(c, i):\n    c.execute(f'SELECT a FROM t WHERE id = {i}')\n"),
    ("python", "def f(u):\n    return requests.get(u, verify=False)\n", "def f(u):\n    return requests.get(u)\n"),
    ("python", "def f(path):\n    if '..' in path:\n        return None\n    return open(path)\n", "def f(path):\n    check_path(path)\n    return open(path)\n"),
    ("javascript", "function f(el, x) {\n  el.textContent = x;\n}\n", "function f(el, x) {\n  el.innerHTML = x;\n}\n"),
    ("javascript", "function g(req, res) {\n  if (!req.session.user) {\n    return res.status(403).end();\n  }\n  run(req);\n}\n", "function g(req, res) {\n  run(req);\n}\n"),
    ("python", "def f(", "def f(): pass"),
)


@query(f"""SELECT o_orderkey AS id, neg, pos, risk, alert FROM orders JOIN (VALUES (0, 2.25::DOUBLE, 0.0::DOUBLE, 'weakened', true), (1, 0.0, 0.9, 'strengthened', false), (3, 0.85, 0.0, 'weakened', true), (4, 0.0, 0.8, 'strengthened', false),
  (5, 0.24, 0.45, 'none', false), (6, 0.85, 0.0, 'weakened', true), (7, 0.6, 0.0, 'weakened', false)) AS x(i, neg, pos, risk, alert) ON o_orderkey % {len(SHAPES)} = i""")
def guard_features(spark, sf_dir):
    shape = F.element_at(F.array(*[F.struct(F.lit(g).alias("language"), F.lit(a).alias("old"), F.lit(b).alias("new")) for g, a, b in SHAPES]), (F.col("o_orderkey") % len(SHAPES) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), shape.alias("s")).select("id", "s.*")
    return features.risk(features.changes(features.features(rows, language="language", differing=True)))


# an order is a review of a function whose limits are the order's numbers: a filled one loses a bound, an open one
# the whole condition, a pending one has it written otherwise; urgent orders gain a bound; every second one is JavaScript
_BOUND = {
    "python": ("def review(lines, depth):\n    total = 0\n%s%s    return total\n", "    if %s:\n        lines = trim(lines)\n", "len(lines) > %s", "not depth >= %s", "depth < %s", " and ", "    if lines.size <= %s:\n        total = 1\n"),
    "javascript": ("function review(lines, depth) {\n  let total = 0;\n%s%s  return total;\n}\n", "  if (%s) {\n    lines = trim(lines);\n  }\n", "lines.length > %s", "!(depth >= %s)", "depth < %s", " && ", "  if (lines.size <= %s) total = 1;\n"),
}


@query("""WITH d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN -2 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS d FROM orders)
SELECT id, 0.25 * greatest(-d, 0) AS neg, 0.25 * greatest(d, 0) AS pos, CASE WHEN d = -2 THEN 'weakened' ELSE 'none' END AS risk, false AS alert FROM d WHERE d <> 0""")
def guard_conditions(spark, sf_dir):
    # dealt out while rows are short: reading code takes half a millisecond
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    size, deep = F.floor("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    status = F.coalesce("o_orderstatus", F.lit(""))

    def sides(language: str):
        frame, block, long, low, low_again, both, more = _BOUND[language]
        fill = lambda pattern, *values: F.format_string(pattern, *values)
        a, b, c = fill(long, size), fill(low, deep), fill(low_again, deep)
        old = fill(frame, fill(block, F.concat(a, F.lit(both), b)), F.lit(""))
        kept = F.when(status == "F", fill(block, a)).when(status == "O", "").when(status == "P", fill(block, F.concat(c, F.lit(both), a))).otherwise(fill(block, F.concat(a, F.lit(both), b)))
        return old, fill(frame, kept, F.when(F.col("o_orderpriority") == "1-URGENT", fill(more, deep)).otherwise(""))

    (py_old, py_new), (js_old, js_new) = sides("python"), sides("javascript")
    script = F.col("o_custkey") % 2 == 1
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(script, js_old).otherwise(py_old).alias("old"), F.when(script, js_new).otherwise(py_new).alias("new"), F.when(script, "javascript").otherwise("python").alias("language"))
    return features.risk(features.changes(features.features(rows, language="language", differing=True)))


# a function for each customer, with its segment and balance in it; every second one is JavaScript
_FUNCTION = {
    "python": "def serve(request, limit):\n    floor = %s\n    segment = '%s'\n    if request.total < floor or not is_allowed(request, segment):\n        raise ValueError(segment)\n    if len(segment) > limit:\n        floor = 0\n    return floor\n",
    "javascript": "function serve(request, limit) {\n  const floor = %s;\n  const segment = '%s';\n  if (request.total < floor || !isAllowed(request, segment)) {\n    throw new Error(segment);\n  }\n  return floor;\n}\n",
}


@query("""SELECT e.edit, count(*) AS n, count(*) AS n_edited, 0::BIGINT AS n_changed, 0::BIGINT AS n_labelled FROM customer, (VALUES ('reorder'), ('rename'), ('log'), ('all')) AS e(edit) GROUP BY e.edit""")
def harmless_edits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    script, values = F.col("c_custkey") % 2 == 1, (F.floor(F.abs("c_acctbal")).cast("string"), F.col("c_mktsegment"))
    code = F.when(script, F.format_string(_FUNCTION["javascript"], *values)).otherwise(F.format_string(_FUNCTION["python"], *values))
    return edits.signals(c.select(F.col("c_custkey").alias("id"), code.alias("code"), F.when(script, "javascript").otherwise("python").alias("language")))


@query()
def greedy_pack(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    units = li.select(F.col("o_custkey").alias("scan"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.col("l_discount").alias("priority"), (F.col("l_quantity") * 100).cast("long").alias("size"))
    return packing.pack(units, "scan")


# a component is a customer, its cells are the priorities of its orders
@query()
def side_assign(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").groupBy(F.lit(0).cast("long").alias("split"), F.col("o_custkey").alias("component"), F.col("o_orderpriority").alias("cell")).agg(F.count("*").alias("n"))
    cells = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return sides.assign_sides(parts, {"dev": dict.fromkeys(cells, 3.0), "test": dict.fromkeys(cells, 1.0)})


# --- exact statistics, lengths, policies, costs

@query("""WITH c AS (SELECT user_id AS id, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id),
t AS (SELECT id, b, c, unnest(range(least(b, c) + 1)) AS i FROM c WHERE b + c > 0)
SELECT id, round(least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 6) AS p FROM t GROUP BY id, b, c UNION ALL SELECT id, 1.0 FROM c WHERE b + c = 0""")
def mcnemar_exact(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(n("click").alias("b"), n("error").alias("c"))
    return c.select("id", r6(exact.mcnemar(F.col("b"), F.col("c")), "p"))


@query(f"""WITH {_SCORED}, t AS (SELECT lang, count(*) FILTER (label AND quality = 1) AS a, count(*) FILTER (label AND quality = 0) AS b, count(*) FILTER (NOT label AND quality = 1) AS c, count(*) FILTER (NOT label AND quality = 0) AS d FROM m GROUP BY lang),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS i FROM t),
y AS (SELECT *, lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - a - b + i + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + b + 1) - lgamma(c + d + 1)) AS lp FROM x),
z AS (SELECT *, max(CASE WHEN i = a THEN lp END) OVER (PARTITION BY lang) AS own FROM y)
SELECT lang, a, b, c, d, round(least(1, sum(exp(lp)) FILTER (lp <= own + 1e-9)), 6) AS p FROM z GROUP BY lang, a, b, c, d""")
def fisher_exact(spark, sf_dir):
    m = _scored(spark, sf_dir)
    n = lambda label, q: F.count_if((F.col("label") == label) & (F.col("quality") == q))
    t = m.groupBy("lang").agg(n(True, 1).alias("a"), n(True, 0).alias("b"), n(False, 1).alias("c"), n(False, 0).alias("d"))
    return t.withColumn("p", F.round(exact.fisher(*(F.col(x) for x in "abcd")), 6))


@query(f"""WITH {_SCORED}, r AS (SELECT lang, n_chars FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM r),
e AS (SELECT lang, list_transform(range(5), lambda q: list_extract(v, round_even(q * (n - 1) / 4.0, 0)::BIGINT + 1)) AS e FROM (SELECT lang, any_value(n) AS n, list(n_chars ORDER BY i) AS v FROM o GROUP BY lang)),
b AS (SELECT lang, CASE WHEN n_chars < e[1] OR n_chars > e[5] THEN NULL WHEN n_chars <= e[2] THEN 0 WHEN n_chars <= e[3] THEN 1 WHEN n_chars <= e[4] THEN 2 ELSE 3 END AS bin FROM r JOIN e USING (lang)),
sh AS (SELECT lang, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS share FROM b WHERE bin IS NOT NULL GROUP BY lang, bin),
i AS (SELECT doc_id, lang, CASE WHEN n_chars < e[1] OR n_chars > e[5] THEN NULL WHEN n_chars <= e[2] THEN 0 WHEN n_chars <= e[3] THEN 1 WHEN n_chars <= e[4] THEN 2 ELSE 3 END AS bin FROM documents LEFT JOIN e USING (lang)),
h AS (SELECT sh.lang, sh.bin, share, count(doc_id) AS have FROM sh LEFT JOIN i ON i.lang = sh.lang AND i.bin = sh.bin GROUP BY ALL),
k AS (SELECT *, least(round_even(min(floor(have / share)) OVER (PARTITION BY lang) * share, 0), have) AS take FROM h),
p AS (SELECT doc_id, lang, bin, row_number() OVER (PARTITION BY lang, bin ORDER BY sha256('11:' || lang || ':' || bin || ':' || doc_id), doc_id) AS j FROM i)
SELECT doc_id, coalesce(j <= take, false) AS length_matched FROM p LEFT JOIN k ON k.lang = p.lang AND k.bin = p.bin""")
def length_matched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").join(d, "doc_id").select("lang", "n_chars")
    return building.length_matched(d, toxic, "lang", "n_chars", "doc_id", 4, 11).select("doc_id", "length_matched")


_VERDICTS = """cand AS (SELECT user_id AS id, CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'uncertain' ELSE 'rejected' END AS verdict, (event_id % 10 + 1)::INT AS confidence, event_id % 5 = 0 AS evidence, event_id % 97 = 0 AS deterministic FROM events),
rec AS (SELECT DISTINCT user_id AS id, CASE user_id % 3 WHEN 0 THEN 'intro' WHEN 1 THEN 'fix' ELSE 'benign' END AS kind FROM events)"""


def _verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    verdict = F.when(i % 3 == 0, "confirmed").when(i % 3 == 1, "uncertain").otherwise("rejected")
    cand = e.select(F.col("user_id").alias("id"), verdict.alias("verdict"), (i % 10 + 1).cast("int").alias("confidence"), (i % 5 == 0).alias("evidence"), (i % 97 == 0).alias("deterministic"))
    kind = F.when(F.col("id") % 3 == 0, "intro").when(F.col("id") % 3 == 1, "fix").otherwise("benign")
    return cand.select("id").distinct().withColumn("kind", kind), cand


_KEEP = [*[(f"confirmed>={k}", f"verdict = 'confirmed' AND confidence >= {k}") for k in (9, 8, 7, 6, 5)],
         *[(f"confirmed>={k} + worth a look", f"verdict = 'confirmed' AND confidence >= {k} OR evidence AND (verdict = 'uncertain' AND confidence >= 4 OR verdict = 'confirmed' AND confidence < {k})") for k in (8, 7)],
         ("confirmed", "verdict = 'confirmed'"), ("confirmed or uncertain", "verdict IN ('confirmed', 'uncertain')"), ("no verifier", "true")]


@query(f"WITH {_VERDICTS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS policy, kind, count(*) FILTER (f) AS k, count(*) AS n, round(count(*) FILTER (f)::DOUBLE / count(*), 6) AS rate FROM (SELECT rec.id, kind, bool_or(deterministic OR {rule}) AS f FROM rec JOIN cand ON rec.id = cand.id GROUP BY ALL) GROUP BY kind" for name, rule in _KEEP))
def policy_curve(spark, sf_dir):
    return evaluation.policy_curve(*_verdicts(spark, sf_dir), ["kind"]).withColumn("rate", F.round("rate", 6))


@query("""WITH m AS (SELECT doc_id, lang, n_chars > 1000 AS strict, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars > 500 OR n_chars < 20 END AS loose FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (loose AND NOT strict) AS lost, count(*) FILTER (strict AND NOT loose) AS strict_only, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (loose AND NOT strict), '') AS ids
FROM m WHERE loose IS NOT NULL AND strict IS NOT NULL GROUP BY lang""")
def view_losses(spark, sf_dir):
    n = F.col("n_chars")
    m = table(spark, sf_dir, "documents").select("doc_id", "lang", (n > 1000).alias("strict"), F.when(n % 7 != 0, (n > 500) | (n < 20)).alias("loose"))
    return evaluation.losses(m, ["lang"], "strict", "loose", "doc_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH l AS (SELECT event_type, 'value' AS measure, value::DOUBLE AS x FROM events WHERE value IS NOT NULL UNION ALL SELECT event_type, 'hour', hour(ts)::DOUBLE FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, measure ORDER BY x) AS i, count(*) OVER (PARTITION BY event_type, measure) AS n FROM l)
SELECT event_type, measure, any_value(n) AS n, round(avg(x), 3) AS mean, min(x) FILTER (i >= ceil(0.9 * n)) AS p90, round(sum(x), 3) AS total FROM o GROUP BY ALL""")
def cost_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.hour("ts").alias("hour"))
    return evaluation.cost_rollup(e, ["event_type"], ["value", "hour"]).withColumn("total", F.round("total", 3)).select("event_type", "measure", "n", "mean", "p90", "total")


@query(f"WITH {_SPANS}, h AS (SELECT DISTINCT point FROM p JOIN s ON p.k = s.k AND abs(d - a) <= 2) SELECT p.point, h.point IS NOT NULL AS hit FROM p LEFT JOIN h ON p.point = h.point")
def proximity_hit(spark, sf_dir):
    s, p = _spans(spark, sf_dir)
    hit = intervals.within(p, s.select("k", "a"), ["k"], "at", "a", 2).select("point").distinct().withColumn("hit", F.lit(True))
    return p.select("point").join(hit, "point", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("""WITH i AS (SELECT doc_id // 2 AS p, doc_id % 3 AS r, doc_id FROM documents), a AS (SELECT p, doc_id, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS n FROM i WHERE r <> 0), b AS (SELECT p, doc_id, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS n FROM i WHERE r = 0)
SELECT coalesce(a.p, b.p)::VARCHAR AS pair, coalesce(a.n, b.n) AS n, a.doc_id AS vuln, b.doc_id AS safe, CASE WHEN a.doc_id IS NULL THEN 'no vulnerable side' WHEN b.doc_id IS NULL THEN 'no safe side' END AS problem FROM a FULL JOIN b ON a.p = b.p AND a.n = b.n""")
def pair_outcomes(spark, sf_dir):
    d = F.col("doc_id")
    name = F.concat(F.floor(d / 2).cast("string"), F.when(d % 3 != 0, "_vuln").otherwise("_safe"))
    out = evaluation.pairs_of(table(spark, sf_dir, "documents").select(name.alias("id"), "doc_id"))
    return out.select("pair", F.col("n").cast("long").alias("n"), F.col("vuln.doc_id").alias("vuln"), F.col("safe.doc_id").alias("safe"), "problem")


@query(f"""WITH {_SCORED}, o AS (SELECT lang, label AS a, pred AS b FROM m WHERE pred IS NOT NULL)
SELECT lang, count(*) AS n, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, round(count(*) FILTER (a OR b)::DOUBLE / count(*), 6) AS union_rate FROM o GROUP BY lang""")
def flag_overlap(spark, sf_dir):
    return evaluation.overlap(_scored(spark, sf_dir), ["lang"], "label", "pred").withColumn("union_rate", F.round("union_rate", 6))


@query("""WITH r AS (SELECT user_id AS kind, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'cached' WHEN 'error' THEN 'error' ELSE 'not_run' END AS status, event_id % 3 AS calls FROM events)
SELECT kind, count(*) AS n, count(*) FILTER (status IN ('ok', 'cached')) AS scored, count(*) FILTER (status = 'error' AND calls > 0) AS errored_partial, count(*) FILTER (status = 'error' AND calls = 0) AS errored_no_result, count(*) FILTER (status = 'not_run') AS not_run FROM r GROUP BY kind""")
def status_counts(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "cached").when(F.col("event_type") == "error", "error").otherwise("not_run")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("kind"), status.alias("status"), (F.col("event_id") % 3).alias("calls"))
    return evaluation.status_counts(r, ["kind"])


@query("""WITH b AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), t AS (SELECT least(1000000, sum(size)) AS n, sum(size) AS total FROM b), s AS (SELECT lang, size, size * n / total::DOUBLE AS share, n FROM b, t),
i AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang) AS i, n - sum(floor(share)) OVER () AS l FROM s) SELECT lang, size, least(floor(share) + CASE WHEN i <= l THEN 1 ELSE 0 END, size)::BIGINT AS quota FROM i""")
def capped_quotas(spark, sf_dir):
    return sampling.largest_remainder(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("size")), "lang", "size", 1_000_000, capped=True)


@query("""WITH r AS (SELECT user_id AS run, event_id, event_id % 500 AS tokens FROM events), w AS (SELECT *, lag(tokens) OVER (PARTITION BY run ORDER BY event_id) AS b, row_number() OVER (PARTITION BY run ORDER BY event_id) AS i FROM r)
SELECT run, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(CASE WHEN i > 1 THEN greatest(2.0, 60.0 * b / 6000) ELSE 0 END + 1.5), 4) AS seconds FROM w GROUP BY run""")
def pacing(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", (F.col("event_id") % 500).alias("tokens"))
    return evaluation.pacing(r, "run", "event_id", "tokens", 2.0, 6000, 1.5).withColumn("seconds", F.round("seconds", 4))


@query("""SELECT event_id, sum(event_id % 50) OVER w AS running_total, sum(event_id % 50) OVER w <= 300 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def budget_cutoff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 50).alias("cost"))
    return evaluation.within_budget(e, ["user_id"], ["ts", "event_id"], "cost", 300).select("event_id", "running_total", "within")


@query("""WITH l AS (SELECT user_id AS call, event_type AS client, arg_max(CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'rate_limit' ELSE 'bad_output' END, event_id) AS o FROM events GROUP BY ALL)
SELECT call, bool_or(o = 'ok') AS answered, string_agg(DISTINCT o, ',' ORDER BY o) AS outcomes, bool_and(o = 'bad_output') AS bad_output FROM l GROUP BY call""")
def final_outcomes(spark, sf_dir):
    i = F.col("event_id")
    o = F.when(i % 4 == 0, "ok").when(i % 4 == 1, "rate_limit").otherwise("bad_output")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("call"), F.col("event_type").alias("client"), "event_id", o.alias("o"))
    return jobs.final_outcomes(e, ["call"], "client", "event_id", "o").withColumn("outcomes", F.array_join("outcomes", ","))


@query("SELECT c_nationkey AS grp, CASE WHEN count(DISTINCT c_mktsegment) FILTER (c_custkey % 7 = 0) = 1 THEN max(c_mktsegment) FILTER (c_custkey % 7 = 0) END AS side, count(DISTINCT c_mktsegment) FILTER (c_custkey % 7 = 0) AS sides FROM customer GROUP BY c_nationkey")
def straddling_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")).alias("side"))
    return sets.straddling(c, "grp", "side")


@query("""WITH u AS (SELECT user_id AS scan, CASE WHEN event_id % 2 = 0 THEN 'budget' ELSE 'too_large' END AS reason, 'u' || lpad(event_id::VARCHAR, 9, '0') AS name FROM events),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scan, reason ORDER BY name) <= 10), n AS (SELECT scan, reason, count(*) AS n FROM u GROUP BY ALL), g AS (SELECT scan, reason, string_agg(name, ', ' ORDER BY name) AS names, count(*) AS k FROM f GROUP BY ALL)
SELECT n.scan, n.reason, n, n || ' unit(s) not reviewed (' || n.reason || '): ' || names || CASE WHEN n > k THEN ' and ' || (n - k) || ' more' ELSE '' END AS note FROM n JOIN g ON n.scan = g.scan AND n.reason = g.reason""")
def leftover_notes(spark, sf_dir):
    i = F.col("event_id")
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan"), F.when(i % 2 == 0, "budget").otherwise("too_large").alias("reason"), F.concat(F.lit("u"), F.lpad(i.cast("string"), 9, "0")).alias("name"))
    return report.leftovers(u, ["scan"], "reason", "name")


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value / 100 WHEN 1 THEN value WHEN 2 THEN NULL ELSE value / 10 END AS x FROM events)
SELECT event_id, CASE WHEN x IS NOT NULL THEN least(10, greatest(1, floor(CASE WHEN x > 0 AND x < 1 THEN x * 10 ELSE x END + 0.5)))::INT END AS confidence FROM v""")
def confidences(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    x = F.when(i % 5 == 0, v / 100).when(i % 5 == 1, v).when(i % 5 == 2, None).otherwise(v / 10)
    return table(spark, sf_dir, "events").select("event_id", T.confidence(x).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN year(d) <= 2022 THEN '<=2022' WHEN year(d) >= 2026 THEN '2026+' ELSE year(d)::VARCHAR END AS bin FROM (SELECT o_orderkey, o_orderdate + INTERVAL 26 YEAR AS d FROM orders)""")
def year_bins(spark, sf_dir):
    d = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 26 * 12), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.year_bin(d).alias("bin"))


_CVSS = """v AS (SELECT o_orderkey, ['N', 'A', 'L', 'P'][o_orderkey % 4 + 1] AS av, ['L', 'H'][o_orderkey // 4 % 2 + 1] AS ac, ['N', 'L', 'H'][o_orderkey // 8 % 3 + 1] AS pr, ['N', 'R'][o_orderkey // 24 % 2 + 1] AS ui,
  ['U', 'C'][o_orderkey // 48 % 2 + 1] AS s, ['N', 'L', 'H'][o_orderkey // 96 % 3 + 1] AS c, ['N', 'L', 'H'][o_orderkey // 288 % 3 + 1] AS i, ['N', 'L', 'H'][o_custkey % 3 + 1] AS a FROM orders)"""


@query(f"""WITH {_CVSS}, n AS (SELECT o_orderkey, s, CASE av WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END AS av, CASE ac WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44 END AS ac, CASE ui WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62 END AS ui,
  CASE pr WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE s WHEN 'C' THEN 0.68 ELSE 0.62 END ELSE CASE s WHEN 'C' THEN 0.5 ELSE 0.27 END END AS pr,
  1 - (1 - CASE c WHEN 'N' THEN 0::DOUBLE WHEN 'L' THEN 0.22 ELSE 0.56 END) * (1 - CASE i WHEN 'N' THEN 0::DOUBLE WHEN 'L' THEN 0.22 ELSE 0.56 END) * (1 - CASE a WHEN 'N' THEN 0::DOUBLE WHEN 'L' THEN 0.22 ELSE 0.56 END) AS iss FROM v),
m AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42::DOUBLE * iss END AS impact, 8.22::DOUBLE * av * ac * pr * ui AS ex FROM n),
z AS (SELECT o_orderkey, CASE WHEN impact <= 0 THEN 0.0 ELSE ceil(round(least(CASE s WHEN 'C' THEN 1.08::DOUBLE ELSE 1 END * (impact + ex), 10) * 10, 9)) / 10 END::DOUBLE AS score FROM m)
SELECT o_orderkey, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS band FROM z""")
def cvss_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n + 1).cast("int"))
    part = lambda m, of, n: F.concat(F.lit(f"/{m}:"), pick(of, n))
    div = lambda n: F.floor(k / n)
    vector = F.concat(F.lit("CVSS:3.1"), part("AV", "NALP", k % 4), part("AC", "LH", div(4) % 2), part("PR", "NLH", div(8) % 3), part("UI", "NR", div(24) % 2), part("S", "UC", div(48) % 2), part("C", "NLH", div(96) % 3), part("I", "NLH", div(288) % 3), part("A", "NLH", F.col("o_custkey") % 3))
    out = table(spark, sf_dir, "orders").select("o_orderkey", T.cvss_score(F.array(F.lit("not a score"), vector)).alias("score"))
    return out.select("o_orderkey", "score", T.severity_band(F.col("score")).alias("band"))


def _bounds(pattern):
    """The pattern with word bounds that know letters beyond ASCII, which those of the SQL engine do not."""
    return pattern.replace(r"\b", r"(?:^|$|[^\pL\pN_])").replace("'", "''")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'no_reason' " + " ".join(f"WHEN regexp_matches(lower(text), '{_bounds(p)}') THEN '{name}'" for name, p in T.REASONS) + " ELSE 'other' END AS bucket FROM documents")
def reason_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.reason_bucket(F.col("text")).alias("bucket"))


_SAYS = lambda column, patterns: "regexp_matches(" + column + ", '(?i)" + _bounds("|".join(patterns)) + "')"
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_CLAIM = "SELECT doc_id, ['src/a.py', 'README.md', 'tests/a.py', 'lib/x.c', 'www/i.html'][doc_id % 5 + 1] AS path, left(text, 80) AS title, text AS whole, ['CWE-89', 'CWE-400', 'CWE-787', 'CWE-1333', NULL][doc_id // 5 % 5 + 1] AS cwe FROM documents WHERE text IS NOT NULL"


@query(f"""WITH c AS ({_CLAIM}), t AS (SELECT *, lower(title || ' ' || whole) AS said FROM c)
SELECT doc_id, CASE WHEN path = 'README.md' THEN 'finding in a documentation file' WHEN path = 'tests/a.py' THEN 'finding in test code'
  WHEN NOT ({_SAYS('said', (building.REGEX_DOS,))} OR coalesce(cwe, '') = 'CWE-1333') AND (coalesce(cwe, '') IN ({_LIST(building.DOS_CWES)}) OR {_SAYS('title', building.DOS)}) THEN 'generic DoS / resource exhaustion finding'
  WHEN {_SAYS('said', building.RATE_LIMITS)} THEN 'generic rate-limiting recommendation' WHEN {_SAYS('said', building.RESOURCES)} THEN 'resource management finding (not a security vulnerability)'
  WHEN path <> 'lib/x.c' AND (coalesce(cwe, '') IN ({_LIST(building.MEMORY_CWES)}) OR {_SAYS('title', building.MEMORY)}) THEN 'memory-safety finding in non-C/C++ code'
  WHEN path = 'www/i.html' AND {_SAYS('said', building.SSRF)} THEN 'SSRF finding in client-side HTML' END AS reason FROM t""")
def exclusion_reasons(spark, sf_dir):
    d, pick = F.col("doc_id"), lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    path, cwe = pick(("src/a.py", "README.md", "tests/a.py", "lib/x.c", "www/i.html"), d), pick(("CWE-89", "CWE-400", "CWE-787", "CWE-1333", None), F.floor(d / 5))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", building.exclusion(path, F.left("text", F.lit(80)), F.col("text"), cwe).alias("reason"))


@query("SELECT doc_id, " + _SAYS("coalesce(text, '')", (building.SECURITY.removeprefix("(?i)"),)) + " AS security FROM documents")
def security_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", building.security_text(F.col("text")).alias("security"))


@query("""WITH o AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_linenumber * 3))) AS changed, list_sort(list_distinct(list(l_linenumber * 3 + 1))) AS shown FROM lineitem WHERE l_linenumber <> 2 GROUP BY l_orderkey),
x AS (SELECT *, CASE WHEN id % 3 > 0 THEN id % 25 END AS exact, CASE WHEN id % 2 = 0 THEN id % 11 END AS start FROM o), w AS (SELECT *, coalesce(exact, start) AS want FROM x)
SELECT id, CASE WHEN coalesce(list_contains(changed, exact), false) OR coalesce(list_contains(shown, exact), false) THEN exact
  WHEN len(list_filter(changed, lambda c: want IS NULL OR c >= want)) > 0 THEN list_min(list_filter(changed, lambda c: want IS NULL OR c >= want))
  ELSE list_min(list_filter(changed, lambda c: abs(c - want) = list_min(list_transform(changed, lambda y: abs(y - want))))) END AS line FROM w""")
def anchor_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 2").withColumn("n", F.col("l_linenumber").cast("long"))
    o = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("n") * 3)).alias("changed"), F.array_sort(F.collect_set(F.col("n") * 3 + 1)).alias("shown"))
    i = F.col("id")
    return o.select("id", T.anchor_line(F.when(i % 3 > 0, i % 25), F.when(i % 2 == 0, i % 11), F.col("changed"), F.col("shown")).alias("line"))


@query(r"""SELECT doc_id, sha256(array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\r?\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')), lambda x: regexp_replace(x, '\s+', '', 'g')), chr(10))) AS body
FROM documents WHERE text IS NOT NULL""")
def code_bodies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", T.body_hash(F.col("text"), F.lit("python")).alias("body"))


@query("""WITH h AS (SELECT o_custkey AS advisory_id, o_custkey % 7 AS repo, o_orderkey // 16 AS commit, o_orderstatus AS eco, o_custkey % 5 = 0 AS held FROM orders), c AS (SELECT * FROM h WHERE NOT held)
SELECT repo, commit, min((eco, advisory_id)).eco AS ecosystem FROM (SELECT repo, commit, {'eco': eco, 'advisory_id': advisory_id} AS p, eco, advisory_id FROM h WHERE held AND advisory_id NOT IN (SELECT advisory_id FROM c) AND (repo, commit) NOT IN (SELECT (repo, commit) FROM c)) GROUP BY repo, commit""".replace("min((eco, advisory_id)).eco", "min(eco)"))
def held_out_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("advisory_id"), (F.col("o_custkey") % 7).alias("repo"), F.floor(F.col("o_orderkey") / 16).alias("commit"), F.col("o_orderstatus").alias("ecosystem"), (F.col("o_custkey") % 5 == 0).alias("held"))
    return building.source_commits(o.filter("held"), o.filter("not held")).select("repo", "commit", "ecosystem")
