"""Command line: python -m spanloom redact | evaluate | compare | combine."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators import predictions as P
from spanloom.operators import spans as S
from spanloom.operators import text as T
from spanloom.session import local_session
from spanloom.sources import notes as N
from spanloom.sources import sinks as K

RULE_LABELS = {"EMAIL": "CONTACT", "PHONE": "CONTACT", "ID": "ID", "DATE": "DATE"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("redact", help="replace mentions; from --text, --text_dir or the standard input")
    r.add_argument("--text")
    r.add_argument("--text_dir", default=os.environ.get("SPANLOOM_TEXT_DIR"))
    r.add_argument("--pred_dir", help="stand-off predictions; without it the rules are used")
    r.add_argument("--repl", default="___")
    r.add_argument("--out", help="folder for the redacted notes; the standard output without it")
    for name, about in (("evaluate", "character and token rates of predictions against gold"), ("compare", "gold and predictions side by side"), ("combine", "predictions and rules per feature")):
        e = sub.add_parser(name, help=about)
        e.add_argument("--text_dir", required=True)
        e.add_argument("--pred_dir", required=True)
        e.add_argument("--gold_dir", required=name != "combine")
        e.add_argument("--out", required=True)
    return p


def redact(spark: SparkSession, notes: DataFrame, predictions: DataFrame | None, repl: str) -> DataFrame:
    """document_id, redacted: by predictions, or else by the rules; notes without any come out as they are."""
    if predictions is None:
        return notes.select("document_id", T.redact_pattern(F.col("text"), "|".join(T.RULES.values()), repl).alias("redacted"))
    s = predictions.where("stop > start AND entity_type <> 'O'").groupBy("document_id").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return notes.join(s, "document_id", "left").select("document_id", T.redact_spans(F.col("text"), F.coalesce("s", none), repl).alias("redacted"))


def evaluate(notes: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Token counts and rates per document."""
    n = notes.join(gold.select("document_id").distinct(), "document_id", "left_semi")
    f = S.token_flags(T.pattern_spans(n, ["document_id"], {"T": T.TOKEN}), gold, pred)
    count = lambda c, k: F.count_if(F.expr(c)).alias(k)
    c = f.groupBy("document_id").agg(F.count("*").alias("n_token"), count("in_gold AND in_pred", "tp"), count("in_pred AND NOT in_gold", "fp"), count("in_gold AND NOT in_pred", "fn"))
    return c.select("*", *L.rates("tp", "fp", "fn"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "redact" and a.text is not None and a.text_dir:
        parser().error("only one of --text and --text_dir")
    spark = spark or SparkSession.getActiveSession() or local_session()
    if a.command == "redact":
        text = a.text if a.text is not None or a.text_dir else sys.stdin.read()
        n = N.inline_note(spark, text) if text is not None else N.read_notes(spark, a.text_dir, None)
        out = redact(spark, n, N.read_annotations(spark, a.pred_dir, ".pred") if a.pred_dir else None, a.repl)
        if a.out:
            K.write_redacted_files(out, a.out)
        else:
            for r in out.orderBy("document_id").toLocalIterator():
                print(r.redacted)
        return 0
    n, p = N.read_notes(spark, a.text_dir), N.read_annotations(spark, a.pred_dir, ".pred")
    if a.command == "combine":
        m = p.select("document_id", "start", "stop", L.map_label(F.col("entity_type"), "simple").alias("label")).where("label IS NOT NULL AND stop > start")
        rules = T.pattern_spans(n, ["document_id"], T.RULES).withColumnRenamed("entity_type", "feature")
        c = P.combined(m, rules, RULE_LABELS).withColumnRenamed("label", "entity_type").select("document_id", "start", "stop", "entity_type").distinct()
        K.write_annotations(K.with_annotation_ids(S.with_entity(c, n)), a.out)
        return 0
    g = N.read_annotations(spark, a.gold_dir)
    if a.command == "evaluate":
        e = evaluate(n, g, p)
        K.write_metrics(e, a.out)
        total = e.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).select(*L.rates("tp", "fp", "fn"))
        for r in K.evaluation_lines(total).collect():  # three lines
            print(r.line)
        return 0
    K.write_csv(P.review(g, p), a.out, order=("document_id", "start"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
