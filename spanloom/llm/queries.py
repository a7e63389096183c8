"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import crosssplit, mixing, neardup, packing, personal, pieces, sharedspans, tokens
from spanloom.session import table, written

#: The statement of problem 2 and 3: runs of three words, notes of at least sixty.
RUN_WORDS, LEAST_WORDS, LINK, CONTAINED = 3, 60, 0.6, 0.8


def _personal(spark: SparkSession, d: str, placeholder: str | None) -> DataFrame:
    notes = table(spark, d, "input_examples").select("guid", "text")
    names = personal.name_kinds(table(spark, d, "name_list"))
    model = personal.trained_model(notes, table(spark, d, "gold_annotations"), names)
    return personal.find_personal(notes, model, names, placeholder=placeholder)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, None).select("guid", "entity_type", "start", "stop")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, "[{}]")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "input_examples"), similarity=LINK, n=RUN_WORDS, least_words=LEAST_WORDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(_groups(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    g = written(_groups(spark, d), "groups")
    n = g.groupBy("group_id").agg(F.min("guid").alias("group_guid"), F.count("*").alias("group_size"))
    return g.join(n, "group_id").select("guid", "group_guid", "group_size")


_P3 = {"contained": CONTAINED, "n": RUN_WORDS, "least_words": LEAST_WORDS}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = crosssplit.split_overlaps(table(spark, d, "input_examples"), **_P3)
    return o.select(F.least("eval_key", "train_key").alias("guid_a"), F.greatest("eval_key", "train_key").alias("guid_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: notes, notes that occur in training, of them unchanged ones, pairs."""
    o = crosssplit.overlap_counts(table(spark, d, "input_examples"), **_P3).withColumnRenamed("eval_key", "guid")
    n = table(spark, d, "input_examples").where("guid IS NOT NULL").groupBy("guid").agg(F.min(crosssplit.clean_split(F.col("split"))).alias("split"), F.min(pieces.clean_name(F.col("source"))).alias("source"))
    j = n.where(F.col("split").isin("dev", "test")).join(o, "guid", "left")
    return j.groupBy("split", "source").agg(
        F.count("*").alias("n_notes"), F.count("n_links").alias("n_overlapping"), F.sum(F.coalesce("unchanged", F.lit(0))).alias("n_unchanged"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_pairs")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_kinds(pieces.split_oversized(table(spark, d, "input_examples"), table(spark, d, "run_configs"), with_text=False))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "input_examples"), table(spark, d, "run_configs"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", pieces.clean_name(F.col("source")))
    return written(tokens.with_token_counts(docs, ["doc_id", "source"]), "sizes")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(tokens.with_token_counts(table(spark, d, "documents"), ["doc_id"]), table(spark, d, "container_specs"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    s = _sizes(spark, d)
    return mixing.mix_documents(s, mixing.mix_rates(s, table(spark, d, "mix_targets")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    s = _sizes(spark, d)
    r = mixing.mix_rates(s, table(spark, d, "mix_targets"))
    return mixing.share_report(mixing.mix_documents(s, r), r)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sharedspans.shared_report(docs, sharedspans.shared_spans(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_redacted, p2_found, p2_groups, p3_found, p3_report, p5_found, p5_pieces, p6_packed, p6_report, p7_mixed, p7_report, p8_found, p8_report)
    return {f.__name__: f for f in fs}


_NOTES = r"""
notes AS (SELECT DISTINCT guid, text, split, source FROM input_examples WHERE guid IS NOT NULL),
w AS (SELECT guid, split, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM notes),
s AS (SELECT DISTINCT guid, CASE WHEN lower(trim(split)) = 'train' THEN 'train' ELSE 'eval' END AS side, len(w) AS n_words,
        unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w),
n AS (SELECT guid, count(*) AS n FROM s GROUP BY guid)
"""

_P2_LINKS = (
    "WITH RECURSIVE "
    + _NOTES
    + """,
x AS (SELECT a.guid AS a, b.guid AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.guid <> b.guid WHERE a.n_words >= 60 AND b.n_words >= 60 GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.guid = a JOIN n nb ON nb.guid = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.6),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
"""
)


_P3_LINKS = (
    "WITH "
    + _NOTES
    + """,
pr AS (SELECT e.guid AS eg, t.guid AS tg FROM s e JOIN s t ON e.run = t.run AND t.side = 'train' JOIN n ON n.guid = e.guid
WHERE e.side = 'eval' AND e.n_words >= 60 GROUP BY e.guid, t.guid, n.n HAVING count(*)::DOUBLE / n.n >= 0.8)"""
)

_P8_SPANS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, p, substring(text, p, 200) AS x FROM d, LATERAL (SELECT unnest(range(1, length(text) - 198)) AS p)),
h AS (SELECT x FROM g GROUP BY x HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT DISTINCT doc_id, p - 1 AS a FROM g JOIN h USING (x)),
f AS (SELECT doc_id, a, CASE WHEN lag(a) OVER (PARTITION BY doc_id ORDER BY a) >= a - 200 THEN 0 ELSE 1 END AS first FROM m),
i AS (SELECT doc_id, a, sum(first) OVER (PARTITION BY doc_id ORDER BY a) AS i FROM f),
sp AS (SELECT doc_id, min(a)::INT AS start, (max(a) + 200)::INT AS stop FROM i GROUP BY doc_id, i)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2_LINKS + "SELECT DISTINCT a AS guid_a, b AS guid_b FROM r WHERE a < b",
        "p2_groups": _P2_LINKS
        + """, g AS (SELECT guid, least(guid, coalesce(min(b), guid)) AS group_guid FROM (SELECT DISTINCT guid FROM notes) q LEFT JOIN r ON r.a = q.guid GROUP BY guid)
SELECT guid, group_guid, count(*) OVER (PARTITION BY group_guid) AS group_size FROM g""",
        "p3_found": _P3_LINKS + " SELECT DISTINCT least(eg, tg) AS guid_a, greatest(eg, tg) AS guid_b FROM pr",
        "p3_report": _P3_LINKS
        + r""", x AS (SELECT guid, ' ' || array_to_string(w, ' ') || ' ' AS x FROM w),
per AS (SELECT eg, count(DISTINCT tg) AS p, max(CASE WHEN contains(t.x, e.x) THEN 1 ELSE 0 END) AS same FROM pr JOIN x e ON e.guid = eg JOIN x t ON t.guid = tg WHERE eg <> tg GROUP BY eg),
b AS (SELECT guid, replace(min(replace(lower(regexp_replace(split, '^\s+|\s+$', '', 'g')), '-', '_')), 'val', 'dev') AS split, min(replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '-', '_')) AS source FROM input_examples WHERE guid IS NOT NULL GROUP BY guid)
SELECT split, source, count(*) AS n_notes, count(p) AS n_overlapping, sum(coalesce(same, 0))::BIGINT AS n_unchanged, sum(coalesce(p, 0))::BIGINT AS n_pairs FROM b LEFT JOIN per ON eg = guid WHERE split IN ('dev', 'test') GROUP BY 1, 2""",
        "p5_found": r"""
WITH c AS (SELECT data_type, min(max_seq_length) AS most, min(sequence_length) AS seq FROM run_configs GROUP BY data_type),
d AS (SELECT DISTINCT guid, text, most, seq FROM input_examples JOIN c ON c.data_type = replace(lower(trim(input_examples.data_type)), '-', '_')),
t AS (SELECT guid, most, seq, len(regexp_extract_all(text, '[^ \t\r\n\x{00a0}]+')) AS n,
        list_max(list_transform(string_split_regex(regexp_replace(text, '[.!?;]([ \t\x{00a0}])', chr(1), 'g'), '[\r\n' || chr(1) || ']+'), lambda x: len(regexp_extract_all(x, '[^ \t\x{00a0}]+')))) AS run FROM d)
SELECT DISTINCT guid, unnest(CASE WHEN run > seq THEN ['oversized', 'unbroken'] ELSE ['oversized'] END) AS kind FROM t WHERE n > most""",
        "p8_found": _P8_SPANS + " SELECT doc_id, start, stop FROM sp",
        "p8_report": _P8_SPANS
        + """, t AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS shared_chars FROM sp GROUP BY 1)
SELECT c.doc_id, c.n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, coalesce(shared_chars / nullif(c.n_chars, 0), 0.0)::DOUBLE AS shared_part
FROM (SELECT doc_id, max(coalesce(length(text), 0))::BIGINT AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) c LEFT JOIN t USING (doc_id)""",
    }
