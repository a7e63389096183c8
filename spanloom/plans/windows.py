"""Queries on sub-words, windows and stand-off predictions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import align as A
from spanloom.operators import predictions as P
from spanloom.operators import text as T
from spanloom.operators.periods import clean_entity_type
from spanloom.plans.alignment import _words
from spanloom.plans.reference import BASE, WORD_TOKENS_SQL, gold, notes, query
from spanloom.session import table

_CONF = r"conf AS (SELECT replace(lower(trim(data_type)), '-', '_') AS kind, min(sequence_length) AS len, min(step_size) AS step FROM run_configs GROUP BY 1)"


@query(
    f"WITH {_CONF}"
    + r""", t AS (SELECT DISTINCT guid, replace(lower(trim(data_type)), '-', '_') AS kind, len(regexp_extract_all(text, '[^ \t\r\n\f\v]+')) AS n FROM input_examples WHERE guid IS NOT NULL)
SELECT guid, g.i::INT AS segment, (g.i * step)::INT AS first_token, least(g.i * step + len, n)::INT AS stop_token FROM t JOIN conf USING (kind), LATERAL (SELECT unnest(range(0, greatest(ceil((n - len) / step::DOUBLE), 0)::INT + 1)) AS i) g WHERE n > 0"""
)
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of sequence_length tokens, step_size apart, by the note's data_type."""
    kind = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    c = table(spark, d, "run_configs").groupBy(kind(F.col("data_type")).alias("kind")).agg(F.min("sequence_length").alias("len"), F.min("step_size").alias("step"))
    n = F.size(F.regexp_extract_all("text", F.lit(f"[^{T.SPACE}]+"), F.lit(0)))
    t = table(spark, d, "input_examples").where("guid IS NOT NULL").select("guid", kind(F.col("data_type")).alias("kind"), n.alias("n")).distinct().where("n > 0")
    s = t.join(c, "kind").select("guid", "n", "len", F.posexplode(A.window_starts(F.col("n"), F.col("len"), F.col("step"))).alias("segment", "first_token"))
    return s.select("guid", "segment", "first_token", F.least(F.col("first_token") + F.col("len"), F.col("n")).cast("int").alias("stop_token"))


_SUB = (
    BASE
    + WORD_TOKENS_SQL
    + """, sub AS (SELECT document_id, pos::INT AS word, p::INT AS piece, (start + p * 4)::INT AS start, least(start + p * 4 + 4, stop)::INT AS stop, p > 0 AS is_sub, start::INT AS word_start, (stop - start - p * 4)::INT AS word_length
 FROM matches, LATERAL (SELECT unnest(range(0, ceil((stop - start) / 4.0)::INT)) AS p)),
num AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY start) - 1)::INT AS idx, count(*) OVER (PARTITION BY document_id) AS n FROM sub)"""
)


def _subs(spark: SparkSession, d: str) -> DataFrame:
    return A.subwords(_words(spark, d))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words with `at`, their number in the note, and `n`, their count. A note's words are one window's rows."""
    w = W.partitionBy("document_id")
    return _subs(spark, d).select("*", (F.row_number().over(w.orderBy("start")) - 1).alias("idx"), F.count("*").over(w).alias("n"))


@query(_SUB + " SELECT * FROM sub")
def subword_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words with their flag, their word's start, and the characters from each to its word's end."""
    return _subs(spark, d)


@query(_SUB + " SELECT count(DISTINCT document_id) AS n_notes, count(DISTINCT (document_id, word)) AS n_words, count(*) AS n_subwords, sum(stop - start)::BIGINT AS n_chars FROM sub")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    per = _subs(spark, d).groupBy("document_id").agg(F.count_if(~F.col("is_sub")).alias("w"), F.count("*").alias("s"), F.sum(F.col("stop") - F.col("start")).alias("c"))
    return per.agg(F.count("*").alias("n_notes"), F.sum("w").alias("n_words"), F.sum("s").alias("n_subwords"), F.sum("c").alias("n_chars"))


_SEG = """, sg AS (SELECT DISTINCT document_id, n, g.i AS segment, g.i * 48 AS s0 FROM num, LATERAL (SELECT unnest(range(0, greatest(ceil((n - 64) / 48.0), 0)::INT + 1)) AS i) g),
sn AS (SELECT sg.document_id, segment::INT AS segment, (s0 - piece)::INT AS first, least(s0 + 64, sg.n)::INT AS stop FROM sg JOIN num ON num.document_id = sg.document_id AND num.idx = s0)"""


def _segments(num: DataFrame, length: int = 64, step: int = 48) -> DataFrame:
    """Windows of `length` sub-words whose start is moved back to the start of its word: document_id, segment, first, stop."""
    w = num.select("document_id", "n").distinct()
    s = w.select("document_id", "n", F.posexplode(A.window_starts(F.col("n"), F.lit(length), F.lit(step))).alias("segment", "idx"))
    return s.join(num.select("document_id", "idx", "piece"), ["document_id", "idx"]).select("document_id", "segment", (F.col("idx") - F.col("piece")).alias("first"), F.least(F.col("idx") + length, F.col("n")).cast("int").alias("stop"))


@query(_SUB + _SEG + " SELECT * FROM sn")
def segments_at_word_starts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 sub-words that overlap by a quarter and start with a whole word; the last token is in a window."""
    return _segments(_numbered(spark, d))


# stand-in scores, since no trained weights are at hand: four labels, from the sub-word's first character and its place
_NAMES = ["O", "NAME", "DATE", "ID"]
_LOGITS = """, lg AS (SELECT num.document_id, segment, start, num.stop, word, word_length, is_sub, list_transform([0, 1, 2, 3], lambda k: ((unicode(substring(text, start + 1, 1)) * (k + 3) + (num.stop - start) * 7 + segment * 5) % 11) / 2.0::DOUBLE) AS v
 FROM sn JOIN num ON num.document_id = sn.document_id AND idx >= first AND idx < sn.stop JOIN notes ON notes.document_id = num.document_id)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    num = _numbered(spark, d)
    at = _segments(num).select("document_id", "segment", F.explode(F.sequence("first", F.col("stop") - 1)).alias("idx"))
    first = F.ascii(F.substring("text", F.col("start") + 1, F.lit(1)))
    j = num.join(at, ["document_id", "idx"]).join(notes(spark, d), "document_id")
    score = lambda k: F.pmod(first * (k + 3) + (F.col("stop") - F.col("start")) * 7 + F.col("segment") * 5, F.lit(11)).cast("double") / 2
    return j.select("document_id", "segment", "start", "stop", "word", "word_length", "is_sub", F.lit(False).alias("special"), F.array(*[score(k) for k in range(4)]).alias("logits"))


@query(
    _SUB
    + _SEG
    + _LOGITS
    + """, la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY document_id, start ORDER BY segment DESC) = 1)
SELECT document_id, start, CASE WHEN is_sub THEN stop - start ELSE word_length END AS length, ['O', 'NAME', 'DATE', 'ID'][list_position(v, list_max(v))] AS label, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 9) AS prob FROM la WHERE list_position(v, list_max(v)) > 1"""
)
def windowed_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = P.standoff(_scored(spark, d), _NAMES)
    return p.withColumn("prob", F.round("prob", 9))


@query(
    _SUB
    + _SEG
    + _LOGITS
    + """, pr AS (SELECT document_id, word, start, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p, segment, is_sub FROM lg),
b AS (SELECT document_id, word, start, segment, round(p[1], 9) AS p_none, list_position(p[2:4], list_max(p[2:4])) AS k FROM pr QUALIFY row_number() OVER (PARTITION BY document_id, word ORDER BY round(p[1], 9), start, segment) = 1)
SELECT document_id, word, p_none, ['NAME', 'DATE', 'ID'][k] AS label FROM b"""
)
def word_least_none(spark: SparkSession, d: str) -> DataFrame:
    """Of a word's scored sub-words the one that is least likely to be none, with its best other label."""
    s = _scored(spark, d).withColumn("p", L.softmax(F.col("logits")))
    none = F.round(F.col("p")[0], 9)
    b = s.groupBy("document_id", "word").agg(F.min_by(F.struct(none.alias("p_none"), "p"), F.struct(none, "start", "segment")).alias("x"))
    return b.select("document_id", "word", "x.p_none", F.element_at(F.array(*[F.lit(n) for n in _NAMES[1:]]), (L.first_argmax(F.slice("x.p", 2, 3)) + 1).cast("int")).alias("label"))


_TOKEN_LABEL = """, og AS (SELECT document_id, start, stop, row_number() OVER (PARTITION BY document_id ORDER BY start, stop, entity_type) AS o, entity_type FROM gold),
wl AS (SELECT num.document_id, num.word, max_by(entity_type, o) AS label FROM num JOIN og ON og.document_id = num.document_id AND num.start >= og.start AND num.start < og.stop WHERE NOT is_sub GROUP BY 1, 2),
ll AS (SELECT num.document_id, idx, start, stop, is_sub, CASE WHEN is_sub THEN NULL ELSE coalesce(label, 'O') END AS label FROM num LEFT JOIN wl USING (document_id, word))"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words with their word's label: null for further sub-words, O outside gold, the last of several."""
    num, g = _numbered(spark, d), gold(spark, d)
    t = num.where("NOT is_sub").select("document_id", "start", "stop", "word")
    inside = A.lower_bound_tokens(g, t).where("start >= span_start")
    of = inside.groupBy("document_id", "start").agg(F.max_by("entity_type", F.struct("span_start", "span_stop", "entity_type")).alias("label"))
    j = num.join(of, ["document_id", "start"], "left")
    return j.select("document_id", "idx", "start", "stop", "is_sub", F.when(~F.col("is_sub"), F.coalesce("label", F.lit("O"))).alias("label"))


@query(_SUB + _TOKEN_LABEL + " SELECT document_id, idx, start, stop, coalesce(label, '-100') AS label FROM ll")
def subword_labels(spark: SparkSession, d: str) -> DataFrame:
    """The training label of each sub-word; '-100', which training ignores, for all but the first of a word."""
    return _labelled(spark, d).select("document_id", "idx", "start", "stop", F.coalesce("label", F.lit("-100")).alias("label"))


@query(
    _SUB
    + _SEG
    + _TOKEN_LABEL
    + """ SELECT sn.document_id, segment, string_agg(ll.start, ' ' ORDER BY idx) AS offsets, string_agg(ll.stop - ll.start, ' ' ORDER BY idx) AS lengths, string_agg(CASE WHEN is_sub THEN '1' ELSE '0' END, '' ORDER BY idx) AS input_subwords, string_agg(coalesce(label, '-100'), ' ' ORDER BY idx) AS label_names
FROM sn JOIN ll ON ll.document_id = sn.document_id AND idx >= first AND idx < sn.stop GROUP BY 1, 2"""
)
def window_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per window: offsets, lengths, sub-word flags and labels of its sub-words in order, as text."""
    at = _segments(_numbered(spark, d)).select("document_id", "segment", F.explode(F.sequence("first", F.col("stop") - 1)).alias("idx"))
    x = _labelled(spark, d).join(at, ["document_id", "idx"]).groupBy("document_id", "segment")
    x = x.agg(F.sort_array(F.collect_list(F.struct("idx", "start", (F.col("stop") - F.col("start")).alias("n"), "is_sub", F.coalesce("label", F.lit("-100")).alias("label")))).alias("x"))
    text = lambda f, by=" ": F.array_join(F.transform("x", f), by)
    return x.select("document_id", "segment", text(lambda y: y["start"].cast("string")).alias("offsets"), text(lambda y: y["n"].cast("string")).alias("lengths"), text(lambda y: y["is_sub"].cast("int").cast("string"), "").alias("input_subwords"), text(lambda y: y["label"]).alias("label_names"))


@query(_SUB + _TOKEN_LABEL + " SELECT document_id, string_agg(label, ' ' ORDER BY idx) AS labels, count(*) AS n FROM ll WHERE label IS NOT NULL GROUP BY 1")
def aligned_label_names(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a note in order without those that training ignores."""
    x = _labelled(spark, d).where("label IS NOT NULL").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("idx", "label"))).alias("x"))
    return x.select("document_id", F.array_join(F.transform("x", lambda y: y["label"]), " ").alias("labels"), F.size("x").cast("bigint").alias("n"))


@query(
    _SUB
    + """, df AS (SELECT num.document_id, idx, max(CASE WHEN is_sub THEN 0 WHEN g.start IS NOT NULL THEN 1 ELSE 0 END) AS f FROM num LEFT JOIN (SELECT * FROM gold WHERE entity_type = 'DATE') g ON g.document_id = num.document_id AND g.start < num.stop AND g.stop > num.start WHERE idx < 127 GROUP BY 1, 2)
SELECT document_id, rpad('0' || string_agg(f, '' ORDER BY idx), 128, '0') AS features FROM df GROUP BY 1"""
)
def extra_feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """128 digits a note: 0 for the opening token and further sub-words, 1 for a first sub-word in a date, padded with 0."""
    n = _numbered(spark, d).where("idx < 127")
    g = gold(spark, d).where("entity_type = 'DATE'").select("document_id", F.col("start").alias("s"), F.col("stop").alias("e"))
    hit = n.where("NOT is_sub").join(g, "document_id").where("s < stop AND e > start").select("document_id", "idx").distinct().withColumn("f", F.lit("1"))
    j = n.join(hit, ["document_id", "idx"], "left").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("f", F.lit("0")).alias("f")))).alias("x"))
    return j.select("document_id", F.rpad(F.concat(F.lit("0"), F.array_join(F.transform("x", lambda y: y["f"]), "")), 128, "0").alias("features"))


@query(
    _SUB
    + """ SELECT num.document_id, idx, max(CASE WHEN g.entity_type = 'DATE' THEN 1 ELSE 0 END)::INT AS is_date, max(CASE WHEN g.entity_type IN ('PHONE', 'FAX') THEN 1 ELSE 0 END)::INT AS is_phone, max(CASE WHEN g.entity_type IN ('DOCTOR', 'PATIENT') THEN 1 ELSE 0 END)::INT AS is_name
FROM num JOIN gold g ON g.document_id = num.document_id AND num.start >= g.start AND num.start < g.stop GROUP BY 1, 2"""
)
def tag_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sub-words that start in a span, with a column for each tag; rows without a tag are left out."""
    t = A.lower_bound_tokens(gold(spark, d), _subs(spark, d)).where("start >= span_start")
    n = _numbered(spark, d).select("document_id", "start", "idx")
    has = lambda *x: F.max(F.col("entity_type").isin(*x).cast("int"))
    return t.join(n, ["document_id", "start"]).groupBy("document_id", "idx").agg(has("DATE").alias("is_date"), has("PHONE", "FAX").alias("is_phone"), has("DOCTOR", "PATIENT").alias("is_name"))


@query(
    """WITH x AS (SELECT trim(regexp_replace(regexp_replace(trim(document_id), '^.*[/\\\\]', ''), '\\.[A-Za-z0-9]+$', '')) AS document_id, start, stop, regexp_replace(upper(trim(entity_type)), '^[BI]-', '') AS entity_type, model_name, epoch_us(created_at) AS c FROM predictions WHERE start IS NOT NULL AND stop > start)
SELECT document_id, start, stop, entity_type FROM x QUALIFY row_number() OVER (PARTITION BY document_id, start ORDER BY c DESC NULLS LAST, model_name DESC NULLS LAST, stop DESC, entity_type DESC NULLS LAST) = 1"""
)
def dedup_last_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Of the predictions at one offset the one made last holds (on ties by model, stop, type)."""
    from spanloom.operators.periods import clean_document_id

    p = table(spark, d, "predictions").where("start IS NOT NULL AND stop > start")
    p = p.select(clean_document_id(F.col("document_id")).alias("document_id"), "start", F.unix_micros("created_at").alias("c"), "model_name", "stop", clean_entity_type(F.col("entity_type")).alias("entity_type"))
    return p.groupBy("document_id", "start").agg(F.max(F.struct("c", "model_name", "stop", "entity_type")).alias("x")).select("document_id", "start", "x.stop", "x.entity_type")
