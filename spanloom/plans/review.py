"""Queries on rules, models side by side, labels, sinks, scores and samples, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import chain as C
from spanloom.operators import predictions as P
from spanloom.operators import spans as S
from spanloom.operators import text as T
from spanloom.plans.alignment import _ALIGNED, _tokens, _with_gold, _words
from spanloom.plans.reference import BASE, _matches_sql, gold, notes, pred, query
from spanloom.sources import sinks as K
from spanloom.session import table


def _rules_sql(source: str, key: str) -> str:
    return " UNION ALL ".join(f"(WITH {_matches_sql(source, key, p)} SELECT {key}, '{k}' AS entity_type, start::INT AS start, stop::INT AS stop, entity FROM matches)" for k, p in T.RULES.items())


@query("SELECT * FROM (" + _rules_sql("documents", "doc_id") + ")")
def rule_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of all rule annotators."""
    return T.pattern_spans(table(spark, d, "documents"), ["doc_id"], T.RULES).drop("pos")


_FEATURES = {"EMAIL": "CONTACT", "PHONE": "CONTACT", "ID": "ID", "DATE": "DATE"}


def _simple_sql(c: str = "entity_type") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.label_map("simple").items()) + " END"


@query(
    BASE
    + ", gn AS (SELECT * FROM notes WHERE document_id IN (SELECT document_id FROM gold)), rs AS ("
    + _rules_sql("gn", "document_id")
    + f"), mo AS (SELECT DISTINCT document_id, start, stop, {_simple_sql()} AS label FROM pm WHERE model_name LIKE 'bert%' AND document_id IN (SELECT document_id FROM gn) AND {_simple_sql()} IS NOT NULL), ft AS (SELECT unnest({list(_FEATURES)}) AS feature, unnest({list(_FEATURES.values())}) AS label),"
    + """ b AS (SELECT DISTINCT * FROM (SELECT document_id, feature, start, stop FROM mo JOIN ft USING (label) UNION ALL SELECT document_id, entity_type, start, stop FROM rs)),
m AS (SELECT *, max(stop) OVER (PARTITION BY document_id, feature ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, feature ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT document_id, feature, label, start, stop FROM (SELECT document_id, feature, min(start) AS start, max(stop) AS stop FROM i GROUP BY document_id, feature, k) JOIN ft USING (feature)
UNION ALL SELECT document_id, NULL, label, start, stop FROM mo WHERE label NOT IN (SELECT label FROM ft)"""
)
def combine_model_rules(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    m = _with_gold(pred(spark, d, "model_name").where(F.col("model_name").startswith("bert")), notes(spark, d).join(g, "document_id", "left_semi"))
    m = m.select("document_id", "start", "stop", L.map_label(F.col("entity_type"), "simple").alias("label")).where("label IS NOT NULL").distinct()
    r = T.pattern_spans(notes(spark, d).join(g, "document_id", "left_semi"), ["document_id"], T.RULES).withColumnRenamed("entity_type", "feature")
    return P.combined(m, r, _FEATURES)


@query(BASE + " SELECT 'gold' AS source, document_id, start, stop, entity_type FROM gold UNION ALL SELECT 'pred', document_id, start, stop, entity_type FROM pred")
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda x, n: x.select(F.lit(n).alias("source"), "document_id", "start", "stop", "entity_type")
    return tag(gold(spark, d), "gold").unionByName(tag(pred(spark, d), "pred"))


_REVIEW = (
    BASE
    + """, b AS (SELECT DISTINCT document_id, start, stop, entity_type FROM pm WHERE model_name LIKE 'bert%' AND document_id IN (SELECT document_id FROM gold)),
rv AS (SELECT document_id, start, stop, gold.entity_type AS type_a, b.entity_type AS type_b, CASE WHEN b.entity_type IS NULL THEN 'a' WHEN gold.entity_type IS NULL THEN 'b' WHEN gold.entity_type = b.entity_type THEN 'same' ELSE 'type' END AS verdict FROM gold FULL JOIN b USING (document_id, start, stop))"""
)


@query(_REVIEW + " SELECT * FROM rv")
def annotator_review(spark: SparkSession, d: str) -> DataFrame:
    """Two annotators side by side: the same span and type, another type, or only one of them."""
    g = gold(spark, d)
    return P.review(g, _with_gold(pred(spark, d, "model_name").where(F.col("model_name").startswith("bert")), g))


@query(
    _REVIEW
    + """, tp AS (SELECT count_if(verdict = 'same')::DOUBLE AS tp, count_if(verdict IN ('same', 'type', 'a') AND type_a IS NOT NULL) AS g, count_if(type_b IS NOT NULL) AS p FROM rv)
SELECT tp / nullif(p, 0) AS precision, tp / nullif(g, 0) AS recall, 2 * tp / nullif(p + g, 0) AS f1 FROM tp"""
)
def sequence_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of chunks: right are those of equal ends and type."""
    n = annotator_review(spark, d).agg(F.expr("count_if(verdict = 'same')").alias("tp"), F.count("type_a").alias("g"), F.count("type_b").alias("p"))
    return n.select(F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "g").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("p") + F.col("g")).alias("f1"))


@query(_ALIGNED + ", n AS (SELECT count(*) AS n FROM matches), w AS (SELECT count(*) AS n FROM al WHERE truth IS DISTINCT FROM pred) SELECT n.n AS n_tokens, w.n AS n_wrong, 1 - w.n / n.n::DOUBLE AS accuracy FROM n, w")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all words and signs; those without a label on either side are right."""
    n = _words(spark, d).agg(F.count("*").alias("n_tokens"))
    w = _tokens(spark, d).where("NOT (truth <=> pred)").agg(F.count("*").alias("n_wrong"))
    return n.crossJoin(w).select("n_tokens", "n_wrong", (1 - F.col("n_wrong") / F.col("n_tokens")).alias("accuracy"))  # one row each


_VOCABULARY = "SELECT scheme, bio, label, (id - 1)::INT AS id FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS scheme, {str(b).lower()} AS bio, unnest({L.vocabulary(s, b)}) AS label, generate_subscripts({L.vocabulary(s, b)}, 1) AS id" for s in L.TAXONOMY for b in (False, True)) + ")"


@query(_VOCABULARY)
def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, b, x, i) for s in L.TAXONOMY for b in (False, True) for i, x in enumerate(L.vocabulary(s, b))]
    return spark.createDataFrame(rows, "scheme string, bio boolean, label string, id int")


@query(BASE + f" SELECT {_simple_sql()} AS label, list_position({L.vocabulary('simple')}, {_simple_sql()})::INT - 1 AS id, CASE WHEN {_simple_sql()} = 'O' THEN 'O' ELSE 'B-' || {_simple_sql()} END AS bio, count(*) AS n FROM gold GROUP BY ALL")
def mapped_label_ids(spark: SparkSession, d: str) -> DataFrame:
    """Harmonised labels of gold with their ids and the label of a span's first word."""
    x = gold(spark, d).select(L.map_label(F.col("entity_type"), "simple", strict=True).alias("label"))
    return x.select("label", L.label_id(F.col("label"), "simple").cast("int").alias("id"), F.when(F.col("label") == "O", "O").otherwise(F.concat(F.lit("B-"), "label")).alias("bio")).groupBy("label", "id", "bio").agg(F.count("*").alias("n"))


@query(
    BASE
    + """, f AS (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR start - 1 > lag(stop) OVER w THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT document_id, start, stop, lower(coalesce(entity_type, 'Other')) AS entity_type FROM pred WHERE document_id IN (SELECT document_id FROM gold)) WINDOW w AS (PARTITION BY document_id, entity_type ORDER BY start, stop)),
g AS (SELECT *, sum(n) OVER (PARTITION BY document_id, entity_type ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM f),
h AS (SELECT document_id, entity_type, min(start) AS start, max_by(stop, start * 100000000::BIGINT + stop) AS stop FROM g GROUP BY document_id, entity_type, i)
SELECT h.*, substring(text, start + 1, stop - start) AS entity FROM h JOIN notes USING (document_id)"""
)
def simplified_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Coalesced types, merged over gaps of one character, with the text of the merged span."""
    p = _with_gold(pred(spark, d), gold(spark, d)).withColumn("entity_type", L.coalesce_entity_type(F.col("entity_type"))).distinct()
    return S.with_entity(S.merge_typed(p, ["document_id", "entity_type"], 1).drop("n_spans"), notes(spark, d))


_NUM = """, x AS (SELECT document_id, (list_transform(string_split_regex(text, '[ \\t\\r\\n\\f\\v]'), lambda t, i: {'t': t, 'i': i})) AS l FROM notes), y AS (SELECT document_id, unnest(l) AS u FROM x),
z AS (SELECT document_id, (u.i - 1)::INT AS pos, u.t AS token, (sum(length(u.t) + 1) OVER (PARTITION BY document_id ORDER BY u.i) - 1)::INT AS stop FROM y)"""


@query(BASE + _NUM + " SELECT document_id, pos, CASE WHEN token = '' THEN coalesce(lag(stop) OVER (PARTITION BY document_id ORDER BY pos), 0) ELSE stop - length(token) END::INT AS start, CASE WHEN token = '' THEN coalesce(lag(stop) OVER (PARTITION BY document_id ORDER BY pos), 0) ELSE stop END::INT AS stop, token FROM z")
def split_tokens_with_empty(spark: SparkSession, d: str) -> DataFrame:
    return T.split_tokens(notes(spark, d))


_FOLD = (
    BASE.replace("WITH notes", "WITH RECURSIVE notes")
    + """, o AS (SELECT document_id, start, stop, row_number() OVER (PARTITION BY document_id ORDER BY start DESC, stop DESC) AS k FROM (SELECT DISTINCT document_id, start, stop FROM {source})),
f AS (SELECT document_id, text AS t, -1 AS last, 0::BIGINT AS k FROM notes WHERE document_id IN (SELECT document_id FROM o)
 UNION ALL SELECT f.document_id, substring(t, 1, start) || '___' || CASE WHEN stop = last THEN substring(t, stop + 4) ELSE substring(t, stop + 1) END, start, o.k FROM f JOIN o ON o.document_id = f.document_id AND o.k = f.k + 1)
SELECT document_id, max_by(t, k) AS redacted FROM f GROUP BY document_id"""
)


def _folded(spans: DataFrame, n: DataFrame) -> DataFrame:
    g = spans.groupBy("document_id").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    return n.join(g, "document_id").select("document_id", T.redact_spans(F.col("text"), F.col("s")).alias("redacted"))


@query(_FOLD.format(source="gold"))
def redact_gold_fold(spark: SparkSession, d: str) -> DataFrame:
    return _folded(gold(spark, d), notes(spark, d))


@query(_FOLD.format(source="(SELECT * FROM pred WHERE document_id IN (SELECT document_id FROM gold))"))
def redact_overlapping_fold(spark: SparkSession, d: str) -> DataFrame:
    """Spans of several models overlap; each edit sees the text that those to its right have left."""
    return _folded(_with_gold(pred(spark, d), gold(spark, d)), notes(spark, d))


_GAPS = (
    BASE
    + """, c AS (SELECT DISTINCT document_id, unnest(range(start, stop)) AS i FROM gold), p AS (SELECT DISTINCT document_id, unnest(range(start, stop)) AS i FROM pred WHERE document_id IN (SELECT document_id FROM gold)),
u AS (SELECT g.document_id, g.start, g.stop, c.i FROM (SELECT DISTINCT document_id, start, stop FROM gold) g JOIN c ON c.document_id = g.document_id AND c.i >= g.start AND c.i < g.stop WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = c.document_id AND p.i = c.i))
SELECT u.document_id, start, stop, string_agg(substring(text, i::INT + 1, 1), '' ORDER BY i) AS uncovered_text FROM u JOIN notes USING (document_id) GROUP BY 1, 2, 3"""
)


@query(_GAPS)
def uncovered_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of what each gold span has uncovered, over all its stretches."""
    g = gold(spark, d)
    e = S.exclude(g.select("document_id", "start", "stop").distinct(), S.merge_union(_with_gold(pred(spark, d), g), ["document_id"])).where("size(gaps) > 0").join(notes(spark, d), "document_id")
    text = F.array_join(F.transform("gaps", lambda x: F.substring(F.col("text"), x["start"] + 1, x["stop"] - x["start"])), "")
    return e.select("document_id", F.col("a").alias("start"), F.col("b").alias("stop"), text.alias("uncovered_text"))


@query(
    BASE
    + """, e AS (SELECT g.*, substring(text, start + 1, stop - start) AS e FROM gold g JOIN notes USING (document_id)),
t AS (SELECT document_id, start + length(e) - length(ltrim(e)) AS start, stop - length(e) + length(rtrim(e)) AS stop, replace(replace(trim(e), chr(13), '\\r'), chr(10), '\\n') AS e, replace(entity_type, ' ', '_') AS t FROM e)
SELECT document_id, 'T' || row_number() OVER (PARTITION BY document_id ORDER BY start, stop, t, e) || chr(9) || t || ' ' || start || ' ' || stop || chr(9) || e AS line FROM t"""
)
def brat_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.brat_lines(S.with_entity(gold(spark, d), notes(spark, d)))


@query(BASE + " SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY start, stop, entity_type)::VARCHAR AS annotation_id, start, stop, entity_type FROM (SELECT * FROM pred WHERE document_id IN (SELECT document_id FROM gold)) QUALIFY entity_type <> 'O'")
def numbered_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a prediction file: numbered before the label O is left out, so numbers may have gaps."""
    return K.with_annotation_ids(_with_gold(pred(spark, d), gold(spark, d))).select("document_id", "annotation_id", "start", "stop", "entity_type")


@query(
    BASE
    + """, e AS (SELECT g.*, substring(text, start + 1, stop - start) AS e FROM gold g JOIN notes USING (document_id))
SELECT document_id, start, stop, start + (CASE WHEN length(e) > 0 AND strpos('.,;:-', e[1]) > 0 THEN 1 ELSE 0 END) AS trimmed_start, stop - (CASE WHEN length(e) > 1 AND strpos('.,;:-', e[-1]) > 0 THEN 1 ELSE 0 END) AS trimmed_stop FROM (SELECT DISTINCT document_id, start, stop, e FROM e)"""
)
def trimmed_spans(spark: SparkSession, d: str) -> DataFrame:
    g = S.with_entity(gold(spark, d).select("document_id", "start", "stop").distinct(), notes(spark, d))
    a, b = P.trimmed(F.col("start"), F.col("stop"), F.col("entity"))
    return g.select("document_id", "start", "stop", a.alias("trimmed_start"), b.alias("trimmed_stop"))


@query(
    BASE
    + """ SELECT g.document_id, g.start, g.stop, count_if(p.start < g.stop AND p.stop > g.start)::BIGINT AS n_overlapping, count_if((p.start >= g.start AND p.start <= g.stop) OR (p.stop >= g.start AND p.stop <= g.stop))::BIGINT AS n_by_ends, count_if(p.start <= g.start AND p.stop > g.start)::BIGINT AS n_containing
FROM (SELECT DISTINCT document_id, start, stop FROM gold) g JOIN (SELECT DISTINCT document_id, start, stop FROM pred WHERE upper(entity_type) = 'DATE') p USING (document_id) GROUP BY 1, 2, 3"""
)
def overlap_predicates(spark: SparkSession, d: str) -> DataFrame:
    """How many DATE predictions overlap a span, overlap it by the test on ends alone (which misses enclosing ones and
    counts touching ones), and contain its first character."""
    g = gold(spark, d).select("document_id", "start", "stop").distinct()
    p = pred(spark, d).where("upper(entity_type) = 'DATE'").select("document_id", F.col("start").alias("a"), F.col("stop").alias("b")).distinct()
    n = lambda c, k: F.count_if(F.expr(c)).alias(k)
    return g.join(p, "document_id").groupBy("document_id", "start", "stop").agg(n("a < stop AND b > start", "n_overlapping"), n("(a >= start AND a <= stop) OR (b >= start AND b <= stop)", "n_by_ends"), n("a <= start AND b > start", "n_containing"))


@query(_GAPS.split("\nSELECT u.document_id")[0] + ", t AS (SELECT u.document_id, start, stop, string_agg(substring(text, i::INT + 1, 1), '' ORDER BY i) AS s FROM u JOIN notes USING (document_id) GROUP BY 1, 2, 3) SELECT document_id, start, stop, s AS rest FROM t WHERE NOT (length(s) = 1 AND s IN (' ', chr(13), chr(10), ';', ':', '-'))")
def partial_misses(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered text but for single blanks, line ends and signs, which count as covered."""
    return uncovered_text(spark, d).where(~F.col("uncovered_text").isin(" ", "\r", "\n", ";", ":", "-")).withColumnRenamed("uncovered_text", "rest")


_PROBS = "WITH e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id, label, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM e)"


def _probs(spark: SparkSession, d: str) -> DataFrame:
    """The first ten numbers of an embedding stand in for the scores of its ten labels."""
    v = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", L.softmax(v).alias("p"))


@query(
    _PROBS
    + """, th AS (SELECT label, avg(p[label + 1]) AS t FROM q GROUP BY label HAVING count(*) >= 5),
c AS (SELECT q.vec_id, q.label, th.label AS k, q.p[th.label + 1] AS pk, q.p[q.label + 1] AS own FROM q, th WHERE q.p[th.label + 1] >= th.t AND q.label IN (SELECT label FROM th)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY pk DESC, k) = 1)
SELECT vec_id, label, k AS suggested, round(own - pk, 9) AS margin FROM b WHERE k <> label ORDER BY round(own - pk, 9), vec_id LIMIT 101"""
)
def noise_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 101 labels most in doubt, by confident learning."""
    return P.noise_ranking(_probs(spark, d), "vec_id", "label", "p").withColumn("margin", F.round("margin", 9)).orderBy("margin", "vec_id").limit(101)


@query("SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE))), 9) AS score FROM embeddings")
def sigmoid_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(L.sigmoid(F.col("embedding")[0].cast("double")), 9).alias("score"))


_PR = """WITH s AS (SELECT list_max(embedding[2:])::DOUBLE AS score, (label > 0)::INT AS y FROM embeddings), c AS (SELECT score, sum(y)::BIGINT AS pos, count(*) AS n FROM s GROUP BY score),
pr AS (SELECT score, (sum(pos) OVER w)::BIGINT AS tp, (sum(n - pos) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS n_pos, (sum(n) OVER ())::BIGINT AS n_all FROM c WINDOW w AS (ORDER BY score DESC))"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct score, the largest score of any label but the first."""
    e = table(spark, d, "embeddings")
    s = e.select(F.array_max(F.slice("embedding", 2, 63)).cast("double").alias("score"), (F.col("label") > 0).cast("int").alias("y"))
    c = s.groupBy("score").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    return P.running_by_score(c, "score", ["tp", "fp"])


@query(_PR + " SELECT score, tp, fp, tp::DOUBLE / (tp + fp) AS ppv, tp::DOUBLE / nullif(n_pos, 0) AS se FROM pr")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("score", "tp", "fp", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("ppv"), F.try_divide("tp", "all_tp").alias("se"))


@query(_PR + " SELECT t.target, max(score) AS score, min(tp) AS tp, min(fp) AS fp, min(n_pos - tp) FILTER (true) AS fn_least, max(n_pos) AS n_pos, min(fp) * 1000.0::DOUBLE / max(n_all) AS fp_per_1000, (max(n_pos) - min(tp)) * 1000.0::DOUBLE / max(n_all) AS fn_per_1000, max(n_pos) - min(tp) AS fn FROM pr, (SELECT unnest([0.997, 0.99, 0.9827])::DOUBLE AS target) t WHERE tp::DOUBLE / n_pos >= t.target GROUP BY t.target".replace("min(n_pos - tp) FILTER (true) AS fn_least, ", ""))
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    """The highest threshold that reaches each sensitivity, with its counts and its errors per 1000 rows."""
    t = F.explode(F.array(*[F.lit(x) for x in (0.997, 0.99, 0.9827)])).alias("target")
    x = _curve(spark, d).select("*", t).where(F.col("tp") / F.col("all_tp") >= F.col("target"))
    x = x.groupBy("target").agg(F.max("score").alias("score"), F.min("tp").alias("tp"), F.min("fp").alias("fp"), F.max("all_tp").alias("n_pos"), F.max(F.col("all_tp") + F.col("all_fp")).alias("n"))
    fn = F.col("n_pos") - F.col("tp")
    return x.select("target", "score", "tp", "fp", fn.alias("fn"), "n_pos", (F.col("fp") * 1000.0 / F.col("n")).alias("fp_per_1000"), (fn * 1000.0 / F.col("n")).alias("fn_per_1000"))


@query(
    BASE
    + """, h AS (SELECT document_id, ('0x' || substr(md5(document_id), 1, 6))::BIGINT % 10 AS h FROM notes)
SELECT f::INT AS percent, count(*) AS n_notes, sum((SELECT count(*) FROM gold g WHERE g.document_id = h.document_id))::BIGINT AS n_spans FROM h, (SELECT unnest(range(10, 101, 10)) AS f) WHERE h.h < f / 10 GROUP BY f"""
)
def learning_curve_samples(spark: SparkSession, d: str) -> DataFrame:
    """Nested samples of 10 to 100 % of the notes by a hash of their id, with their gold spans."""
    n = notes(spark, d).select("document_id", (F.conv(F.substring(F.md5("document_id"), 1, 6), 16, 10).cast("bigint") % 10).alias("h"))
    c = n.join(gold(spark, d).groupBy("document_id").agg(F.count("*").alias("s")), "document_id", "left")
    by = c.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.coalesce("s", F.lit(0))).alias("s"))  # ten rows
    f = by.select("n", "s", F.explode(F.sequence((F.col("h") + 1) * 10, F.lit(100), F.lit(10))).alias("percent"))
    return f.groupBy(F.col("percent").cast("int").alias("percent")).agg(F.sum("n").alias("n_notes"), F.sum("s").alias("n_spans"))


@query(
    _ALIGNED
    + """, g AS (SELECT document_id, truth AS label, count(*) AS n, min(start) AS f FROM al WHERE truth IS NOT NULL GROUP BY 1, 2)
SELECT document_id, label, n FROM g QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1"""
)
def modal_label_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """A note's most frequent token label; of equally frequent ones the one that comes first in the note."""
    g = _tokens(spark, d).where("truth IS NOT NULL").groupBy("document_id", F.col("truth").alias("label")).agg(F.count("*").alias("n"), F.min("start").alias("f"))
    return g.groupBy("document_id").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "f")).alias("x")).select("document_id", "x.label", "x.n")


@query("SELECT model_name, n_types FROM (SELECT model_name, count(DISTINCT entity_type) AS n_types, count(*) AS n FROM predictions GROUP BY 1) ORDER BY n DESC, model_name LIMIT 5")
def models_preview(spark: SparkSession, d: str) -> DataFrame:
    """The five models with the most rows."""
    return table(spark, d, "predictions").groupBy("model_name").agg(F.count_distinct("entity_type").alias("n_types"), F.count("*").alias("n")).orderBy(F.desc("n"), "model_name").limit(5).drop("n")


# a chain of eight steps over four labels from the first 32 numbers of an embedding, with fixed transitions
_T = [[((3 * i + 5 * j) % 7) / 10 for j in range(4)] for i in range(4)]
_S, _E = [0.1, 0.0, -0.2, 0.3], [0.0, 0.2, 0.1, -0.1]


def _emissions() -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("embedding", t * 4 + j).cast("double")))


@query(
    f"""WITH RECURSIVE t AS (SELECT i, j, v FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j), (SELECT {_T} AS tt) q, LATERAL (SELECT tt[i + 1][j + 1]::DOUBLE AS v)),
f AS (SELECT vec_id, 0 AS k, j, embedding[j + 1]::DOUBLE + {_S}[j + 1] AS s, [j] AS p FROM embeddings, (SELECT unnest(range(0, 4)) AS j)
 UNION ALL SELECT * FROM (SELECT f.vec_id, f.k + 1 AS k, t.j, f.s + t.v + e.embedding[(f.k + 1) * 4 + t.j + 1]::DOUBLE AS s, list_append(f.p, t.j) AS p FROM f JOIN t ON t.i = f.j JOIN embeddings e ON e.vec_id = f.vec_id WHERE f.k < 7 QUALIFY row_number() OVER (PARTITION BY f.vec_id, t.j ORDER BY f.s + t.v DESC, f.j) = 1))
SELECT vec_id, round(s + {_E}[j + 1], 6) AS score, array_to_string(p, '') AS path FROM f WHERE k = 7 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s + {_E}[j + 1] DESC, j) = 1"""
)
def crf_viterbi(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", _emissions().alias("e")).select("vec_id", C.viterbi(F.col("e"), _T, _S, _E).alias("v"))
    return v.select("vec_id", F.round("v.score", 6).alias("score"), F.array_join(F.transform("v.path", lambda x: x.cast("string")), "").alias("path"))


def crf_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of the path that repeats the row's label modulo 4."""
    x = table(spark, d, "embeddings").select("vec_id", _emissions().alias("e"), F.array_repeat((F.col("label") % 4).cast("int"), 8).alias("y"))
    return x.select("vec_id", F.round(C.log_likelihood(F.col("e"), F.col("y"), _T, _S, _E), 6).alias("llh"))


query(
    f"""WITH RECURSIVE t AS (SELECT i, j, {_T}[i + 1][j + 1]::DOUBLE AS v FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)),
f AS (SELECT vec_id, 0 AS k, j, embedding[j + 1]::DOUBLE + {_S}[j + 1] AS s FROM embeddings, (SELECT unnest(range(0, 4)) AS j)
 UNION ALL SELECT * FROM (SELECT f.vec_id, f.k + 1 AS k, t.j, ln(sum(exp(f.s + t.v))) + any_value(e.embedding[(f.k + 1) * 4 + t.j + 1])::DOUBLE AS s FROM f JOIN t ON t.i = f.j JOIN embeddings e ON e.vec_id = f.vec_id WHERE f.k < 7 GROUP BY f.vec_id, f.k, t.j)),
z AS (SELECT vec_id, ln(sum(exp(s + {_E}[j + 1]))) AS z FROM f WHERE k = 7 GROUP BY vec_id),
o AS (SELECT vec_id, label % 4 AS y, list_sum(list_transform(range(0, 8), lambda k: embedding[k * 4 + label % 4 + 1]::DOUBLE)) AS em FROM embeddings)
SELECT o.vec_id, round(em + {_S}[y + 1] + {_E}[y + 1] + 7 * {_T}[y + 1][y + 1] - z, 6) AS llh FROM o JOIN z USING (vec_id)"""
)(crf_log_likelihood)


@query(BASE + " SELECT entity_type, (dense_rank() OVER (ORDER BY entity_type) - 1)::INT AS id, n FROM (SELECT entity_type, count(*) AS n FROM pred WHERE entity_type IS NOT NULL GROUP BY 1)")
def compact_label_ids(spark: SparkSession, d: str) -> DataFrame:
    """The labels that occur, numbered on without gaps; one row a label, so the one window is small."""
    n = pred(spark, d).where("entity_type IS NOT NULL").groupBy("entity_type").agg(F.count("*").alias("n"))
    return n.select("entity_type", (F.dense_rank().over(W.orderBy("entity_type")) - 1).cast("int").alias("id"), "n")
