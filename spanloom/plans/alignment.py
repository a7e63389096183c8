"""Queries on the labels of characters and tokens, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import align as A
from spanloom.operators import spans as S
from spanloom.operators import text as T
from spanloom.plans.reference import BASE, WORD_TOKENS_SQL, gold, notes, pred, query
from spanloom.session import table


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words and signs of the notes with gold."""
    return T.pattern_spans(notes(spark, d).join(gold(spark, d), "document_id", "left_semi"), ["document_id"], {"T": T.WORD_PUNCT})


def _with_gold(p: DataFrame, g: DataFrame) -> DataFrame:
    return p.join(g.select("document_id").distinct(), "document_id", "left_semi")


def _chars_sql(name: str, source: str, *more: str) -> str:
    keys = ", ".join((*more, "document_id"))
    return f"""{name} AS (SELECT {keys}, i::INT AS i, entity_type AS label FROM (SELECT DISTINCT {keys}, start, stop, entity_type, unnest(range(start, stop)) AS i FROM {source})
 QUALIFY row_number() OVER (PARTITION BY {keys}, i ORDER BY start DESC, stop DESC, entity_type DESC) = 1)"""


_CHARS = BASE + ", " + _chars_sql("gc", "gold") + ", " + _chars_sql("pc", "(SELECT * FROM pred WHERE document_id IN (SELECT document_id FROM gold))")


@query(
    _CHARS
    + """, t AS (SELECT gc.document_id, count(*) AS n FROM gc JOIN pc USING (document_id, i) WHERE gc.label = pc.label GROUP BY 1), gn AS (SELECT document_id, count(*) AS n FROM gc GROUP BY 1), pn AS (SELECT document_id, count(*) AS n FROM pc GROUP BY 1)
SELECT gn.document_id, gn.n AS n_true, coalesce(pn.n, 0) AS n_pred, coalesce(t.n, 0) AS tp, coalesce(pn.n, 0) - coalesce(t.n, 0) AS fp, gn.n - coalesce(t.n, 0) AS fn FROM gn LEFT JOIN pn USING (document_id) LEFT JOIN t USING (document_id)"""
)
def char_confusion_by_label(spark: SparkSession, d: str) -> DataFrame:
    """A character is right only with the right label; of overlapping spans the last writes it."""
    g = gold(spark, d)
    t, p = A.char_labels(g).withColumnRenamed("label", "g"), A.char_labels(_with_gold(pred(spark, d), g)).withColumnRenamed("label", "p")
    n = t.join(p, ["document_id", "i"], "full").groupBy("document_id").agg(F.count("g").alias("n_true"), F.count("p").alias("n_pred"), F.expr("count_if(g = p)").alias("tp"))
    return n.select("*", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"))


_PARTS = """, x AS (SELECT t.document_id, t.start AS ts, c.i, coalesce(gc.label, '') AS g FROM matches t, LATERAL (SELECT unnest(range(t.start, t.stop))::INT AS i) c LEFT JOIN gc ON gc.document_id = t.document_id AND gc.i = c.i),
y AS (SELECT *, CASE WHEN g > lag(g) OVER (PARTITION BY document_id, ts ORDER BY i) THEN 1 ELSE 0 END AS cut FROM x),
z AS (SELECT *, sum(cut) OVER (PARTITION BY document_id, ts ORDER BY i) AS k FROM y),
parts AS (SELECT document_id, ts, k, min(i) AS start, max(i) + 1 AS stop FROM z GROUP BY ALL),
tc AS (SELECT document_id, ts, k, g, count(*) AS n FROM z GROUP BY document_id, ts, k, g QUALIFY row_number() OVER (PARTITION BY document_id, ts, k ORDER BY n DESC, g) = 1),
truths AS (SELECT document_id, start, stop, nullif(g, '') AS truth FROM parts JOIN tc USING (document_id, ts, k))"""
_ALIGNED = (
    BASE
    + WORD_TOKENS_SQL
    + ", "
    + _CHARS.removeprefix(BASE + ", ")
    + _PARTS
    + """, pp AS (SELECT document_id, start, stop, pc.label, count(*) AS n FROM parts JOIN pc USING (document_id) WHERE pc.i >= start AND pc.i < stop GROUP BY document_id, start, stop, pc.label QUALIFY row_number() OVER (PARTITION BY document_id, start, stop ORDER BY n DESC, label) = 1),
al AS (SELECT document_id, start::INT AS start, stop::INT AS stop, truth, label AS pred FROM truths LEFT JOIN pp USING (document_id, start, stop) WHERE truth IS NOT NULL OR label IS NOT NULL)"""
)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, token_start, start, stop, truth, pred, token)"""
    return A.labelled_tokens(notes(spark, d), S.cleaned(table(spark, d, "gold_annotations")), S.cleaned(table(spark, d, "predictions")))


@query(_ALIGNED + " SELECT * FROM al")
def token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, cut where the true label rises, with true and predicted label; those without either are left out."""
    return _tokens(spark, d).select("document_id", "start", "stop", "truth", "pred")


@query(_ALIGNED.split(", pp AS")[0] + " SELECT p.document_id, p.ts::INT AS token_start, p.start::INT AS start, p.stop::INT AS stop FROM parts p WHERE (p.document_id, p.ts) IN (SELECT (document_id, ts) FROM z WHERE g <> '')")
def token_parts_on_rise(spark: SparkSession, d: str) -> DataFrame:
    t = A.labelled_tokens(notes(spark, d), S.cleaned(table(spark, d, "gold_annotations")), all_parts=True)
    return t.select("document_id", "token_start", "start", "stop")


_BY_LABEL = """, bl AS (SELECT document_id, label, count(*) FILTER (truth = label) AS phi, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (pred = label AND truth IS DISTINCT FROM label) AS fp, count(*) FILTER (truth = label AND pred IS DISTINCT FROM label) AS fn
 FROM (SELECT *, unnest(CASE WHEN truth = pred THEN [truth] WHEN truth IS NULL THEN [pred] WHEN pred IS NULL THEN [truth] ELSE [truth, pred] END) AS label FROM al) GROUP BY 1, 2)"""


def _by_label(al: DataFrame) -> DataFrame:
    """One row per aligned token and label on either of its sides, with g and p: whether that side has it."""
    x = al.select("*", F.explode(F.array_distinct(F.array_compact(F.array("truth", "pred")))).alias("label"))
    return x.select("document_id", "label", F.coalesce(F.col("truth") == F.col("label"), F.lit(False)).alias("g"), F.coalesce(F.col("pred") == F.col("label"), F.lit(False)).alias("p"))


def _counts() -> list:
    return [F.expr(f"count_if({c})").alias(k) for k, c in (("phi", "g"), ("tp", "g AND p"), ("fp", "p AND NOT g"), ("fn", "g AND NOT p"))]


@query(_ALIGNED + _BY_LABEL + " SELECT * FROM bl")
def label_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _by_label(_tokens(spark, d)).groupBy("document_id", "label").agg(*_counts())


@query(
    _ALIGNED
    + _BY_LABEL
    + """ SELECT CASE WHEN grouping(label) = 1 THEN 'All' ELSE label END AS label, grouping(label)::INT AS is_total, sum(phi)::BIGINT AS phi, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
 sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0) AS se, sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0) AS ppv, (2 * sum(tp))::DOUBLE / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS f1 FROM bl GROUP BY ROLLUP(label)"""
)
def label_token_rates(spark: SparkSession, d: str) -> DataFrame:
    """Micro rates per label and over all labels; the total is told by is_total, not by a label."""
    r = _by_label(_tokens(spark, d)).rollup("label").agg(F.grouping("label").cast("int").alias("is_total"), *_counts())
    return r.select(F.when(F.col("is_total") == 1, "All").otherwise(F.col("label")).alias("label"), "is_total", "phi", "tp", "fp", "fn", *L.rates("tp", "fp", "fn"))


@query(
    _ALIGNED
    + """ SELECT CASE WHEN grouping(document_id) = 1 THEN 'All' ELSE document_id END AS document_id, grouping(document_id)::INT AS is_total, count(truth) AS n_phi, count(*) FILTER (truth IS NOT NULL AND pred IS NULL) AS fn,
 round(coalesce(count_if(truth IS NOT NULL AND pred IS NOT NULL)::DOUBLE / nullif(count(truth), 0), 1.0), 4) AS se, round(coalesce(count_if(truth IS NOT NULL AND pred IS NOT NULL)::DOUBLE / nullif(count(pred), 0), 1.0), 4) AS ppv FROM al GROUP BY ROLLUP(document_id)"""
)
def missed_tokens_per_document(spark: SparkSession, d: str) -> DataFrame:
    """Missed tokens and rates (whatever the label; 1 where nothing counts; to 4 digits) per document and over all."""
    both = F.expr("count_if(truth IS NOT NULL AND pred IS NOT NULL)")
    rate = lambda n: F.round(F.coalesce(F.try_divide(both, F.count(n)), F.lit(1.0)), 4)
    r = _tokens(spark, d).rollup("document_id").agg(F.grouping("document_id").cast("int").alias("is_total"), F.count("truth").alias("n_phi"), F.expr("count_if(truth IS NOT NULL AND pred IS NULL)").alias("fn"), rate("truth").alias("se"), rate("pred").alias("ppv"))
    return r.withColumn("document_id", F.when(F.col("is_total") == 1, "All").otherwise(F.col("document_id")))


@query(_ALIGNED + " SELECT document_id, label, count(*) AS fn FROM (SELECT document_id, truth AS label FROM al WHERE truth IS NOT NULL AND pred IS NULL) GROUP BY 1, 2")
def missed_tokens_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).where("truth IS NOT NULL AND pred IS NULL").groupBy("document_id", F.col("truth").alias("label")).agg(F.count("*").alias("fn"))


_MODELS = (
    BASE
    + WORD_TOKENS_SQL
    + ", "
    + _chars_sql("gc", "gold")
    + ", "
    + _chars_sql("mc", "(SELECT * FROM pm WHERE document_id IN (SELECT document_id FROM gold))", "model_name")
    + _PARTS
    + """, mp AS (SELECT model_name, document_id, start, stop, mc.label, count(*) AS n FROM parts JOIN mc USING (document_id) WHERE mc.i >= start AND mc.i < stop GROUP BY model_name, document_id, start, stop, mc.label QUALIFY row_number() OVER (PARTITION BY model_name, document_id, start, stop ORDER BY n DESC, label) = 1),
ms AS (SELECT DISTINCT model_name FROM pm), ma AS (SELECT ms.model_name, document_id, start::INT AS start, stop::INT AS stop, truth, label AS pred FROM truths CROSS JOIN ms LEFT JOIN mp USING (model_name, document_id, start, stop) WHERE truth IS NOT NULL OR label IS NOT NULL)"""
)


def _model_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(model_name, document_id, token_start, start, stop, truth, pred, token). The model names are a handful."""
    p = S.cleaned(table(spark, d, "predictions"), "model_name")
    models = p.agg(F.collect_set(F.struct("model_name")).alias("ms")).select(F.transform("ms", lambda x: x["model_name"]).alias("ms"))  # one row
    return A.labelled_tokens(notes(spark, d), S.cleaned(table(spark, d, "gold_annotations")), p, models)


@query(_MODELS + " SELECT model_name, document_id, count(*) FILTER (truth = pred) AS tp, count(*) FILTER (pred IS NULL) AS fn, count(*) FILTER (truth IS NULL) AS fp, count(*) FILTER (truth <> pred) AS mismatch FROM ma GROUP BY 1, 2")
def comparison_by_model(spark: SparkSession, d: str) -> DataFrame:
    return _model_tokens(spark, d).groupBy("model_name", "document_id").agg(*[F.expr(f"count_if({c})").alias(k) for k, c in (("tp", "truth = pred"), ("fn", "pred IS NULL"), ("fp", "truth IS NULL"), ("mismatch", "truth <> pred"))])


@query(_MODELS + " SELECT model_name, m.document_id AS record, truth, pred, substring(text, start + 1, stop - start) AS token, start, stop - start AS length FROM ma m JOIN notes USING (document_id)")
def token_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the token comparison sink, which writes them by model, record and start."""
    length = (F.col("stop") - F.col("start")).alias("length")
    return _model_tokens(spark, d).select("model_name", F.col("document_id").alias("record"), "truth", "pred", "token", "start", length)


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query(_ALIGNED + f" SELECT document_id, start, stop, truth, token FROM (SELECT al.*, substring(text, start + 1, stop - start) AS token FROM al JOIN notes USING (document_id)) WHERE truth IS NOT NULL AND strpos('{_PUNCT}', token) = 0")
def phi_tokens_without_signs(spark: SparkSession, d: str) -> DataFrame:
    """True sub-tokens with their text, but for signs and runs of signs as they stand in the list of signs."""
    j = _tokens(spark, d).where("truth IS NOT NULL")
    return j.select("document_id", "start", "stop", "truth", "token").where(F.expr("position(token, '%s') = 0" % _PUNCT.replace("\\", "\\\\").replace("''", "\\'")))


@query(
    _ALIGNED
    + """, te AS (SELECT m.document_id, m.start, m.stop, count(DISTINCT al.truth) AS labels, coalesce(bool_and(al.truth IS NOT DISTINCT FROM al.pred), false) AS same, bool_or(al.truth IS NOT NULL) AS phi, bool_or(al.pred IS NOT NULL) AS hit
 FROM matches m JOIN al ON al.document_id = m.document_id AND al.start >= m.start AND al.stop <= m.stop GROUP BY ALL)
SELECT document_id, count(*) FILTER (phi AND hit) AS tp_any, count(*) FILTER (phi AND same AND labels = 1) AS tp_exact, count(*) FILTER (hit AND NOT phi) AS fp, count(*) FILTER (phi AND NOT hit) AS fn FROM te GROUP BY 1"""
)
def token_classes_any_and_exact(spark: SparkSession, d: str) -> DataFrame:
    """Whole tokens: hit by any prediction, or exactly: one true label, and that predicted for all its parts."""
    t = _tokens(spark, d).groupBy("document_id", "token_start").agg(F.count_distinct("truth").alias("labels"), F.bool_and(F.expr("truth <=> pred")).alias("same"), F.bool_or(F.expr("truth IS NOT NULL")).alias("phi"), F.bool_or(F.expr("pred IS NOT NULL")).alias("hit"))
    return t.groupBy("document_id").agg(*[F.expr(f"count_if({c})").alias(k) for k, c in (("tp_any", "phi AND hit"), ("tp_exact", "phi AND same AND labels = 1"), ("fp", "hit AND NOT phi"), ("fn", "phi AND NOT hit"))])


@query(
    _CHARS
    + WORD_TOKENS_SQL
    + """, s AS (SELECT m.document_id, m.start AS ts, c.i, coalesce(gc.label, '') AS g, coalesce(pc.label, '') AS p FROM matches m, LATERAL (SELECT unnest(range(m.start, m.stop))::INT AS i) c
 LEFT JOIN gc ON gc.document_id = m.document_id AND gc.i = c.i LEFT JOIN pc ON pc.document_id = m.document_id AND pc.i = c.i),
f AS (SELECT *, CASE WHEN g IS DISTINCT FROM lag(g) OVER w OR p IS DISTINCT FROM lag(p) OVER w THEN 1 ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY document_id, ts ORDER BY i)),
h AS (SELECT *, sum(c) OVER (PARTITION BY document_id, ts ORDER BY i) AS k FROM f)
SELECT document_id, ts::INT AS token_start, min(i)::INT AS start, (max(i) + 1)::INT AS stop, nullif(min(g), '') AS truth, nullif(min(p), '') AS pred FROM h WHERE g <> '' OR p <> '' GROUP BY document_id, ts, k"""
)
def token_runs_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tokens cut at each change of their characters' true or predicted label; parts without either are left out."""
    g = gold(spark, d)
    t, p = A.char_labels(g).withColumnRenamed("label", "truth"), A.char_labels(_with_gold(pred(spark, d), g)).withColumnRenamed("label", "pred")
    c = A.token_chars(_words(spark, d).select("document_id", "start", "stop"), t.join(p, ["document_id", "i"], "full"))
    w = W.partitionBy("document_id", "start").orderBy("i")
    new = F.lag("i").over(w).isNull() | (F.lag("i").over(w) < F.col("i") - 1) | F.expr("NOT (truth <=> lag(truth) OVER (PARTITION BY document_id, start ORDER BY i)) OR NOT (pred <=> lag(pred) OVER (PARTITION BY document_id, start ORDER BY i))")
    c = c.withColumn("k", F.sum(new.cast("int")).over(w))
    r = c.groupBy("document_id", F.col("start").alias("token_start"), "k", "truth", "pred").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    return r.select("document_id", "token_start", "start", "stop", "truth", "pred")


@query(
    BASE
    + WORD_TOKENS_SQL
    + """, lt AS (SELECT document_id, max(start) AS start, arg_max(stop, start) AS stop FROM matches GROUP BY 1)
SELECT DISTINCT g.document_id, g.entity_type, g.start AS span_start, g.stop AS span_stop, m.start::INT AS start, m.stop AS stop FROM gold g JOIN matches m ON m.document_id = g.document_id AND m.start >= g.start AND m.start < g.stop
UNION ALL SELECT g.document_id, g.entity_type, g.start, g.stop, lt.start::INT, lt.stop FROM gold g JOIN lt USING (document_id) WHERE lt.start < g.start"""
)
def token_label_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    return A.lower_bound_tokens(gold(spark, d), _words(spark, d))


@query(
    BASE
    + WORD_TOKENS_SQL
    + """, e AS (SELECT document_id, g.start AS s, g.stop AS e, max(m.pos) FILTER (m.stop <= g.start) AS p, min(m.pos) FILTER (m.start >= g.stop) AS q FROM (SELECT DISTINCT document_id, start, stop FROM gold) g JOIN matches m USING (document_id) GROUP BY ALL)
SELECT document_id, s AS start, e AS stop, coalesce(string_agg(entity, ' ' ORDER BY pos) FILTER (pos <= p AND pos > p - 3), '') AS before, coalesce(string_agg(entity, ' ' ORDER BY pos) FILTER (pos >= q AND pos < q + 3), '') AS after FROM e JOIN matches USING (document_id) GROUP BY ALL"""
)
def token_context_3(spark: SparkSession, d: str) -> DataFrame:
    return A.context_of_tokens(gold(spark, d), _words(spark, d))
