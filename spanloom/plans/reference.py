"""Queries over notes, gold spans and predictions, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import spans as S
from spanloom.operators import text as T
from spanloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "input_examples").where("guid IS NOT NULL").groupBy(F.col("guid").alias("document_id")).agg(F.min("text").alias("text"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_spans(table(spark, d, "gold_annotations"))


def pred(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return S.clean_spans(table(spark, d, "predictions"), *more)


_CLEAN = r"""trim(regexp_replace(regexp_replace(trim(document_id), '^.*[/\\]', ''), '\.[A-Za-z0-9]+$', '')) AS document_id, start, stop,
  regexp_replace(upper(trim(entity_type)), '^[BI]-', '') AS entity_type"""
BASE = f"""WITH notes AS (SELECT guid AS document_id, min(text) AS text FROM input_examples WHERE guid IS NOT NULL GROUP BY guid),
gold AS (SELECT DISTINCT {_CLEAN} FROM gold_annotations WHERE start IS NOT NULL AND stop > start),
pm AS (SELECT DISTINCT {_CLEAN}, model_name FROM predictions WHERE start IS NOT NULL AND stop > start),
pred AS (SELECT DISTINCT document_id, start, stop, entity_type FROM pm)"""


def _union_sql(name: str, source: str) -> str:
    return f""", {name}_d AS (SELECT DISTINCT document_id, start, stop FROM {source}),
{name}_m AS (SELECT *, max(stop) OVER (PARTITION BY document_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {name}_d),
{name}_g AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM {name}_m),
{name} AS (SELECT document_id, min(start) AS start, max(stop) AS stop FROM {name}_g GROUP BY document_id, i)"""


def _matches_sql(source: str, key: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""m0 AS (SELECT {key}, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM {source}),
m1 AS (SELECT {key}, unnest(m) AS entity, unnest(list_transform(m, lambda x, i: i)) AS i, unnest(p[1:len(m)]) AS before FROM m0),
mt AS (SELECT {key}, (i - 1)::INT AS pos, entity, (sum(length(before) + length(entity)) OVER (PARTITION BY {key} ORDER BY i))::INT AS stop FROM m1),
matches AS (SELECT {key}, pos, entity, stop - length(entity) AS start, stop FROM mt)"""


@query("WITH " + _matches_sql("documents", "doc_id", T.RULES["EMAIL"]) + " SELECT doc_id, entity, start::INT AS start, stop FROM matches")
def regex_spans(spark: SparkSession, d: str) -> DataFrame:
    return T.pattern_spans(table(spark, d, "documents"), ["doc_id"], {"EMAIL": T.RULES["EMAIL"]}).select("doc_id", "entity", "start", "stop")


@query(" UNION ALL ".join(f"SELECT '{k}' AS entity_type, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS n_spans FROM documents" for k, p in T.RULES.items()))
def spans_by_type_count(spark: SparkSession, d: str) -> DataFrame:
    n = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n")) for k, p in T.RULES.items()])
    return table(spark, d, "documents").select(F.explode(n).alias("x")).groupBy("x.entity_type").agg(F.sum("x.n").alias("n_spans"))


@query(f"SELECT doc_id, regexp_replace(text, '{'|'.join(T.RULES.values())}', '___', 'g') AS redacted FROM documents")
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redact_pattern(F.col("text"), "|".join(T.RULES.values())).alias("redacted"))


@query(BASE + ", " + _matches_sql("notes", "document_id", r"[^ \t\r\n\f\v]+") + " SELECT document_id, pos, start::INT AS start, stop, entity AS token FROM matches")
def whitespace_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.pattern_spans(notes(spark, d), ["document_id"], {"T": T.TOKEN}).select("document_id", "pos", "start", "stop", F.col("entity").alias("token"))


@query(BASE + ", " + _matches_sql("notes", "document_id", r"[\p{L}\p{N}_]+|[^ \t\r\n\f\v\p{L}\p{N}_]") + " SELECT document_id, pos, start::INT AS start, stop, entity AS token FROM matches")
def word_punct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.pattern_spans(notes(spark, d), ["document_id"], {"T": T.WORD_PUNCT}).select("document_id", "pos", "start", "stop", F.col("entity").alias("token"))


_STOP = r"[,.;_\\/?!@#$%^&*()-]"


@query(f"""SELECT token, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+')), '{_STOP}', '', 'g') AS token FROM documents) WHERE token <> '' GROUP BY token""")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(F.split("text", "[ \\t\\r\\n\\f\\x0b]+")).alias("t")).select(F.regexp_replace("t", _STOP, "").alias("token"))
    return t.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@query(BASE + " SELECT document_id FROM notes WHERE document_id IN (SELECT document_id FROM gold)")
def notes_with_gold(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("document_id").join(gold(spark, d), "document_id", "left_semi")


@query(BASE + " SELECT model_name, count(*) AS n_unknown FROM (SELECT DISTINCT model_name, document_id FROM pm WHERE document_id NOT IN (SELECT document_id FROM notes)) GROUP BY model_name")
def predictions_without_note(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d, "model_name").select("model_name", "document_id").distinct()
    ids = table(spark, d, "input_examples").select(F.col("guid").alias("document_id"))
    return p.join(ids, "document_id", "left_anti").groupBy("model_name").agg(F.count("*").alias("n_unknown"))


@query(BASE + _union_sql("u", "pred") + " SELECT * FROM u")
def merge_union_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_union(pred(spark, d), ["document_id"])


@query(
    BASE
    + """, f AS (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR start - 1 > lag(stop) OVER w THEN 1 ELSE 0 END AS n FROM pred WINDOW w AS (PARTITION BY document_id, entity_type ORDER BY start, stop)),
g AS (SELECT *, sum(n) OVER (PARTITION BY document_id, entity_type ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT document_id, entity_type, min(start) AS start, max_by(stop, start * 100000000::BIGINT + stop) AS stop, count(*) AS n_spans FROM g GROUP BY document_id, entity_type, i"""
)
def merge_typed_dist1(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_typed(pred(spark, d), ["document_id", "entity_type"], 1)


@query(BASE + _union_sql("g", "gold") + _union_sql("q", "pred") + " SELECT g.document_id, greatest(g.start, q.start) AS start, least(g.stop, q.stop) AS stop FROM g JOIN q ON g.document_id = q.document_id AND g.start < q.stop AND q.start < g.stop")
def char_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.overlap(S.merge_union(gold(spark, d), ["document_id"]), S.merge_union(pred(spark, d), ["document_id"]))


@query(BASE + _union_sql("u", "(SELECT document_id, start, stop FROM gold UNION ALL SELECT document_id, start, stop FROM pred)") + " SELECT * FROM u")
def char_either(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_union(gold(spark, d).unionByName(pred(spark, d)), ["document_id"])


_EXCLUDE = (
    BASE
    + _union_sql("q", "pred")
    + _union_sql("gu", "gold")
    + """, {name} AS (SELECT * FROM {source}),
pts AS (SELECT g.document_id, g.start AS a, g.stop AS b, CASE WHEN q.start IS NOT NULL THEN greatest(q.start, g.start) END AS s, CASE WHEN q.start IS NOT NULL THEN least(q.stop, g.stop) END AS e FROM (SELECT DISTINCT document_id, start, stop FROM {name}) g
  LEFT JOIN q ON q.document_id = g.document_id AND q.start < g.stop AND g.start < q.stop),
lst AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY document_id, a, b ORDER BY s), a) AS lo, lead(s) OVER (PARTITION BY document_id, a, b ORDER BY s) AS nx FROM pts),
seg AS (SELECT document_id, a, b, lo AS s, coalesce(s, b) AS e FROM lst UNION ALL SELECT document_id, a, b, e, b FROM lst WHERE nx IS NULL AND e IS NOT NULL),
gaps AS (SELECT * FROM seg WHERE s < e)"""
)


@query(_EXCLUDE.format(name="ex", source="gu") + " SELECT document_id, s AS start, e AS stop FROM gaps")
def char_exclude(spark: SparkSession, d: str) -> DataFrame:
    e = S.exclude(S.merge_union(gold(spark, d), ["document_id"]), S.merge_union(pred(spark, d), ["document_id"]))
    return e.select("document_id", F.inline("gaps"))


@query(
    _EXCLUDE.format(name="ex", source="gold")
    + """ SELECT g.document_id, g.start, g.stop, CASE WHEN count(p.s) = 0 THEN 'exact' WHEN count(p.s) = 1 AND min(p.s) = g.start AND max(p.e) = g.stop THEN 'missed' ELSE 'partial' END AS coverage,
 coalesce(string_agg(p.s || ' ' || p.e, ';' ORDER BY p.s), '') AS uncovered
FROM (SELECT DISTINCT document_id, start, stop FROM gold) g LEFT JOIN gaps p ON p.document_id = g.document_id AND p.a = g.start AND p.b = g.stop GROUP BY g.document_id, g.start, g.stop"""
)
def coverage_exact_partial_missed(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage(gold(spark, d), pred(spark, d))


_CHAR = (
    BASE
    + _union_sql("g", "gold")
    + _union_sql("q", "pred")
    + """, t AS (SELECT g.document_id, sum(least(g.stop, q.stop) - greatest(g.start, q.start)) AS tp FROM g JOIN q ON g.document_id = q.document_id AND g.start < q.stop AND q.start < g.stop GROUP BY 1),
gl AS (SELECT document_id, sum(stop - start) AS n FROM g GROUP BY 1), ql AS (SELECT document_id, sum(stop - start) AS n FROM q GROUP BY 1),
cc AS (SELECT notes.document_id, length(text)::BIGINT AS n_char, gl.n::BIGINT AS phi, coalesce(tp, 0)::BIGINT AS tp, (coalesce(ql.n, 0) - coalesce(tp, 0))::BIGINT AS fp, (gl.n - coalesce(tp, 0))::BIGINT AS fn
 FROM notes JOIN gl USING (document_id) LEFT JOIN ql USING (document_id) LEFT JOIN t USING (document_id))"""
)


@query(_CHAR + " SELECT * FROM cc")
def char_confusion_per_doc(spark: SparkSession, d: str) -> DataFrame:
    g, q = S.merge_union(gold(spark, d), ["document_id"]), S.merge_union(pred(spark, d), ["document_id"])
    length = F.sum(F.col("stop") - F.col("start")).cast("bigint")
    t = S.overlap(g, q).groupBy("document_id").agg(length.alias("tp"))
    j = notes(spark, d).select("document_id", F.length("text").cast("bigint").alias("n_char")).join(g.groupBy("document_id").agg(length.alias("phi")), "document_id")
    j = j.join(q.groupBy("document_id").agg(length.alias("n_pred")), "document_id", "left").join(t, "document_id", "left").na.fill(0, ["n_pred", "tp"])
    return j.select("document_id", "n_char", "phi", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("phi") - F.col("tp")).alias("fn"))


_TOK = (
    BASE
    + ", gn AS (SELECT * FROM notes WHERE document_id IN (SELECT document_id FROM gold)), "
    + _matches_sql("gn", "document_id", r"[^ \t\r\n\f\v]+")
    + """, fl AS (SELECT document_id, start, stop, entity, EXISTS (SELECT 1 FROM gold g WHERE g.document_id = m.document_id AND g.start < m.stop AND g.stop > m.start) AS in_gold,
 EXISTS (SELECT 1 FROM pred p WHERE p.document_id = m.document_id AND p.start < m.stop AND p.stop > m.start) AS in_pred FROM matches m),
tc AS (SELECT document_id, count(*) AS n_token, count_if(in_gold)::BIGINT AS phi, count_if(in_gold AND in_pred)::BIGINT AS tp, count_if(in_pred AND NOT in_gold)::BIGINT AS fp, count_if(in_gold AND NOT in_pred)::BIGINT AS fn FROM fl GROUP BY document_id)"""
)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return S.flagged_tokens(notes(spark, d), gold(spark, d), pred(spark, d))


def _confusion(flags: DataFrame) -> DataFrame:
    return flags.groupBy("document_id").agg(
        F.max("n_split").alias("n_token"), F.expr("count_if(in_gold)").alias("phi"), F.expr("count_if(in_gold AND in_pred)").alias("tp"), F.expr("count_if(in_pred AND NOT in_gold)").alias("fp"), F.expr("count_if(in_gold AND NOT in_pred)").alias("fn")
    )


@query(_TOK + r" SELECT document_id, len(string_split_regex(text, '[ \t\r\n\f\v]'))::BIGINT AS n_token, phi, tp, fp, fn FROM tc JOIN notes USING (document_id)")
def token_confusion_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """n_token is the number of white space signs and one, so that empty tokens count; they are never in a span."""
    return _confusion(_flags(spark, d))


_RATES = "{tp}::DOUBLE / nullif({tp} + {fn}, 0) AS se, {tp}::DOUBLE / nullif({tp} + {fp}, 0) AS ppv, (2 * {tp})::DOUBLE / nullif(2 * {tp} + {fp} + {fn}, 0) AS f1"


@query(_TOK + " SELECT " + _RATES.format(tp="sum(tp)", fp="sum(fp)", fn="sum(fn)") + " FROM tc")
def micro_rates(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(_flags(spark, d)).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).select(*L.rates("tp", "fp", "fn"))


@query(_TOK + ", r AS (SELECT " + _RATES.format(tp="tp", fp="fp", fn="fn") + " FROM tc) SELECT round(avg(se), 9) AS se, round(avg(ppv), 9) AS ppv, round(avg(f1), 9) AS f1 FROM r")
def macro_rates(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(_flags(spark, d)).select(*L.rates("tp", "fp", "fn")).agg(*[F.round(F.avg(x), 9).alias(x) for x in ("se", "ppv", "f1")])


_ENT = """, k AS (SELECT DISTINCT document_id FROM gold),
x AS (SELECT m.model_name, entity_type, g.start IS NOT NULL AS g, p.start IS NOT NULL AS p FROM (SELECT DISTINCT model_name FROM pm) m CROSS JOIN gold g LEFT JOIN pm p USING (document_id, start, stop, entity_type, model_name)
 UNION ALL SELECT model_name, entity_type, false, true FROM pm p WHERE document_id IN (SELECT document_id FROM k) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.document_id = p.document_id AND g.start = p.start AND g.stop = p.stop AND g.entity_type = p.entity_type))"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """(model_name, entity_type, g, p): exact entity matches over documents with gold. Models are a handful of names."""
    g = gold(spark, d)
    p = pred(spark, d, "model_name").join(g.select("document_id").distinct(), "document_id", "left_semi")
    on = ["document_id", "start", "stop", "entity_type"]
    by = p.groupBy(*on).agg(F.collect_set("model_name").alias("ms")).withColumn("p", F.lit(True))
    models = p.agg(F.array_sort(F.collect_set("model_name")).alias("all"))
    j = g.withColumn("g", F.lit(True)).join(by, on, "full").crossJoin(F.broadcast(models))  # one row
    ms = F.when(F.col("g"), F.col("all")).otherwise(F.col("ms"))
    j = j.select("entity_type", F.coalesce("g", F.lit(False)).alias("g"), "ms", F.explode(ms).alias("model_name"))
    return j.select("model_name", "entity_type", "g", F.coalesce(F.array_contains("ms", F.col("model_name")), F.lit(False)).alias("p"))


_TP = "count_if(g AND p)::BIGINT AS tp, count_if(p AND NOT g)::BIGINT AS fp, count_if(g AND NOT p)::BIGINT AS fn"


def _tpf() -> list:
    return [F.expr("count_if(g AND p)").alias("tp"), F.expr("count_if(p AND NOT g)").alias("fp"), F.expr("count_if(g AND NOT p)").alias("fn")]


@query(BASE + _ENT + f" SELECT model_name, {_TP} FROM x GROUP BY model_name")
def entity_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).groupBy("model_name").agg(*_tpf())


@query(BASE + _ENT + f" SELECT model_name, entity_type, {_TP} FROM x GROUP BY model_name, entity_type")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).groupBy("model_name", "entity_type").agg(*_tpf())


@query(BASE + _ENT + " SELECT CASE WHEN grouping(entity_type) = 1 THEN 'All' ELSE entity_type END AS entity_type, grouping(entity_type)::INT AS is_total, count_if(g AND NOT p)::BIGINT AS fn, coalesce(count_if(g AND p)::DOUBLE / nullif(count_if(g), 0), 1.0) AS se FROM x GROUP BY ROLLUP(entity_type)")
def fn_by_label_with_total(spark: SparkSession, d: str) -> DataFrame:
    r = _entities(spark, d).rollup("entity_type").agg(F.grouping("entity_type").cast("int").alias("is_total"), *_tpf())
    se = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0)).alias("se")
    return r.select(F.when(F.col("is_total") == 1, "All").otherwise(F.col("entity_type")).alias("entity_type"), "is_total", "fn", se)


@query(
    BASE
    + """, b AS (SELECT model_name, document_id, count_if(g.start IS NOT NULL AND g.entity_type = p.entity_type)::BIGINT AS tp, count_if(g.start IS NOT NULL AND g.entity_type <> p.entity_type)::BIGINT AS mismatch, count_if(g.start IS NULL)::BIGINT AS fp
 FROM pm p LEFT JOIN gold g USING (document_id, start, stop) WHERE document_id IN (SELECT document_id FROM gold) GROUP BY 1, 2) SELECT * FROM b"""
)
def mismatch_by_model(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    p = pred(spark, d, "model_name").join(g.select("document_id").distinct(), "document_id", "left_semi")
    j = p.join(g.withColumnRenamed("entity_type", "gt"), ["document_id", "start", "stop"], "left")
    return j.groupBy("model_name", "document_id").agg(F.expr("count_if(gt = entity_type)").alias("tp"), F.expr("count_if(gt <> entity_type)").alias("mismatch"), F.expr("count_if(gt IS NULL)").alias("fp"))


def _map_sql(scheme: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.label_map(scheme).items())
    return BASE + f" SELECT CASE entity_type {cases} END AS label, count(*) AS n_spans FROM gold GROUP BY 1"


def _mapped(scheme: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return gold(spark, d).groupBy(L.map_label(F.col("entity_type"), scheme, strict=True).alias("label")).agg(F.count("*").alias("n_spans"))

    f.__name__ = f"map_labels_{scheme}"
    return f


for _s in L.TAXONOMY:
    query(_map_sql(_s))(_mapped(_s))

WORD_TOKENS_SQL = ", gn AS (SELECT * FROM notes WHERE document_id IN (SELECT document_id FROM gold)), " + _matches_sql("gn", "document_id", r"[\p{L}\p{N}_]+|[^ \t\r\n\f\v\p{L}\p{N}_]")
_BIO = BASE + WORD_TOKENS_SQL + """, bio AS (SELECT m.document_id, CASE WHEN row_number() OVER (PARTITION BY g.document_id, g.entity_type, g.start, g.stop ORDER BY m.start) = 1 THEN 'B-' ELSE 'I-' END || g.entity_type AS label, m.start, m.stop
 FROM gold g JOIN matches m ON m.document_id = g.document_id AND m.start >= g.start AND m.stop <= g.stop)"""


def _bio(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    n = notes(spark, d).join(g, "document_id", "left_semi")
    return S.bio_split(g, T.pattern_spans(n, ["document_id"], {"T": T.WORD_PUNCT}))


@query(_BIO + " SELECT * REPLACE (start::INT AS start) FROM bio")
def bio_split(spark: SparkSession, d: str) -> DataFrame:
    return _bio(spark, d)


@query(
    _BIO
    + """, o AS (SELECT *, sum(CASE WHEN label[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY start, stop, label ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT DISTINCT * FROM bio)),
q AS (SELECT *, row_number() OVER (PARTITION BY document_id, i ORDER BY start, stop, label) AS f, row_number() OVER (PARTITION BY document_id, i ORDER BY start DESC, stop DESC, label DESC) AS l FROM o WHERE i > 0)
SELECT document_id, min(start)::INT AS start, max(CASE WHEN l = 1 THEN stop END) AS stop, max(CASE WHEN f = 1 THEN label[3:] END) AS entity_type FROM q GROUP BY document_id, i"""
)
def bio_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.bio_merge(_bio(spark, d).distinct())


@query("SELECT lower(coalesce(CASE WHEN entity_type IN ('initials', 'firstname', 'lastname') THEN 'Name' ELSE entity_type END, CASE WHEN contains(model_name, 'wmrn') THEN 'Identifier' WHEN contains(model_name, 'name') OR contains(model_name, 'initials') THEN 'Name' END, 'Other')) AS entity_type, count(*) AS n FROM predictions GROUP BY 1")
def coalesce_entity_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy(L.coalesce_entity_type(F.col("entity_type"), F.col("model_name")).alias("entity_type")).agg(F.count("*").alias("n"))


@query(BASE + _union_sql("u", "(SELECT document_id, start, stop FROM pm WHERE model_name LIKE 'bert%' UNION ALL SELECT document_id, start, stop FROM pm WHERE model_name LIKE 'rules%')") + " SELECT * FROM u")
def adjuvant_union(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d, "model_name")
    return S.merge_union(p.where(F.col("model_name").startswith("bert")).unionByName(p.where(F.col("model_name").startswith("rules"))), ["document_id"])


@query(
    BASE
    + """ SELECT g.document_id, g.start, g.stop, g.entity_type, translate(substring(text, greatest(g.start - 50, 0) + 1, g.start - greatest(g.start - 50, 0)) || '**' || substring(text, g.start + 1, g.stop - g.start) || '**' || substring(text, g.stop + 1, 50), chr(13) || chr(10), '  ') AS context
FROM gold g JOIN notes USING (document_id) WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.document_id = g.document_id AND p.start < g.stop AND p.stop > g.start)"""
)
def error_log_rows(spark: SparkSession, d: str) -> DataFrame:
    g, p = gold(spark, d), pred(spark, d).select(F.col("document_id").alias("pd"), F.col("start").alias("ps"), F.col("stop").alias("pe"))
    missed = g.join(p, (g.document_id == p.pd) & (p.ps < g.stop) & (p.pe > g.start), "left_anti")
    j = missed.join(notes(spark, d), "document_id")
    return j.select("document_id", "start", "stop", "entity_type", T.context(F.col("text"), F.col("start"), F.col("stop")).alias("context"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, v, list_max(v) AS m FROM e) SELECT vec_id, (list_position(v, m) - 1)::BIGINT AS label_id, round(1.0 / list_sum(list_transform(v, lambda x: exp(x - m))), 9) AS prob FROM p")
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", L.first_argmax(F.col("v")).alias("label_id"), F.round(F.array_max(L.softmax(F.col("v"))), 9).alias("prob"))


@query(
    BASE
    + """, gc AS (SELECT DISTINCT document_id, unnest(range(start, stop)) AS i FROM gold), pc AS (SELECT DISTINCT document_id, unnest(range(start, stop)) AS i FROM pred),
c AS (SELECT coalesce(gc.document_id, pc.document_id) AS document_id, coalesce(gc.i, pc.i) AS i, CASE WHEN pc.i IS NULL THEN 'fn' WHEN gc.i IS NULL THEN 'fp' ELSE 'tp' END AS state FROM gc FULL JOIN pc ON gc.document_id = pc.document_id AND gc.i = pc.i),
v AS (SELECT c.*, text, c.i - row_number() OVER (PARTITION BY document_id, state ORDER BY c.i) AS run FROM c JOIN notes USING (document_id) WHERE c.i >= 0 AND c.i < length(text))
SELECT document_id, min(i)::INT AS start, (max(i) + 1)::INT AS stop, state, translate(substring(min(text), min(i)::INT + 1, (max(i) + 1 - min(i))::INT), ' ' || chr(13) || chr(10), '___') AS shown FROM v GROUP BY document_id, state, run"""
)
def state_runs(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).withColumn("_n", F.length("text"))
    j = S.state_runs(gold(spark, d), pred(spark, d)).join(n, "document_id").withColumn("start", F.greatest("start", F.lit(0))).withColumn("stop", F.least("stop", "_n")).where("start < stop")
    shown = F.translate(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")), " \r\n", "___")
    return j.select("document_id", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "state", shown.alias("shown"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20")
def notes_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").offset(20).limit(50)


@query(BASE + ", c AS (SELECT document_id, entity_type, count(*) AS n FROM pred GROUP BY 1, 2) SELECT document_id, entity_type, n FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, entity_type) = 1")
def modal_label_per_doc(spark: SparkSession, d: str) -> DataFrame:
    c = pred(spark, d).groupBy("document_id", "entity_type").agg(F.count("*").alias("n"))
    return c.groupBy("document_id").agg(F.min_by(F.struct("entity_type", "n"), F.struct(-F.col("n"), "entity_type")).alias("m")).select("document_id", "m.*")
