"""Sinks: redacted notes, stand-off CSV, brat lines, metrics, error logs, coloured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.text import csv_cell

PREDICTION = ("document_id", "annotation_id", "start", "stop", "entity", "entity_type", "comment")
#: Terminal colours of a character's state.
COLOURS = {"tp": "\x1b[92m", "fn": "\x1b[91m", "fp": "\x1b[93m"}
END = "\x1b[0m"


def with_annotation_ids(df: DataFrame) -> DataFrame:
    """annotation_id from 1 within a document, by the order of the predictions, before labels O are left out (so gaps stay)."""
    w = W.partitionBy("document_id").orderBy("start", "stop", "entity_type")
    return df.withColumn("annotation_id", F.row_number().over(w).cast("string")).where("entity_type <> 'O'")


def write_csv(df: DataFrame, folder: str, gzip: bool = False, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """CSV with a header, gzipped if so asked; a folder for each value of `by`; rows of a part in `order`."""
    d = df.repartition(*by) if by else df
    d = d.sortWithinPartitions(*by, *order) if by or order else d
    w = d.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip" if gzip else "none")
    (w.partitionBy(*by) if by else w).csv(folder)


def write_annotations(df: DataFrame, folder: str, per_document: bool = False) -> None:
    """Stand-off CSV (the columns of PREDICTION; those that are missing are null), one folder per document if so asked."""
    d = df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in PREDICTION])
    write_csv(d, folder, by=("document_id",) if per_document else (), order=("start", "stop"))


def write_offsets(df: DataFrame, folder: str) -> None:
    """Batch predictions: probability, entity_type, offset, length, a folder per document, by offset, length and type."""
    write_csv(df.select("document_id", "probability", "entity_type", "offset", "length"), folder, by=("document_id",), order=("offset", "length", "entity_type"))


def write_redacted(df: DataFrame, folder: str) -> None:
    """Parquet of document_id and redacted text."""
    df.select("document_id", "redacted").write.mode("overwrite").parquet(folder)


def write_redacted_files(df: DataFrame, folder: str) -> None:
    """A folder per document with the redacted text as its one text file."""
    df.select("document_id", "redacted").repartition("document_id").write.mode("overwrite").partitionBy("document_id").text(folder)


def write_metrics(df: DataFrame, folder: str, compared: bool = False) -> None:
    """Metrics per document, or the token comparison (`compared`: gzipped, by model, record and start)."""
    write_csv(df, folder, gzip=compared, order=("model_name", "record", "start") if compared else ())


def write_lines(df: DataFrame, folder: str, line: str = "line", order: tuple[str, ...] = ()) -> None:
    """Text lines: error logs, brat files, evaluation results."""
    (df.sortWithinPartitions(*order) if order else df).select(line).write.mode("overwrite").text(folder)


def evaluation_lines(df: DataFrame, names: tuple[str, ...] = ("se", "ppv", "f1")) -> DataFrame:
    """`name = value` lines of each row's rates."""
    pairs = F.array(*[F.concat(F.lit(f"{n} = "), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in names])
    return df.select(F.explode(pairs).alias("line"))


def prediction_lines(df: DataFrame) -> DataFrame:
    """document_id, line: `i,predicted,true` of a document's aligned tokens in order, i from 0."""
    i = F.row_number().over(W.partitionBy("document_id").orderBy("start", "stop")) - 1
    return df.select("document_id", F.concat_ws(",", i.cast("string"), F.coalesce("pred", F.lit("O")), F.coalesce("truth", F.lit("O"))).alias("line"))


def wide_probabilities(df: DataFrame, labels: list[str]) -> DataFrame:
    """Probability rows with one column per label, as the probability files have them."""
    return df.select("document_id", "token", "label_id", *[F.col("probs")[x].alias(x) for x in labels])


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def brat_lines(df: DataFrame) -> DataFrame:
    """document_id, line: brat text-bound lines `T1<tab>TYPE start stop<tab>entity`. Outer blanks are trimmed with their
    offsets shifted, line ends are written as \\n, blanks in the type as _. Ids of the form T<number> that are given
    once in the document are kept; the others are numbered on from the largest."""
    e = F.col("entity")
    lead = F.length(e) - F.length(F.ltrim(e))
    tail = F.length(e) - F.length(F.rtrim(e))
    d = df.select("document_id", (F.col("start") + lead).alias("start"), (F.col("stop") - tail).alias("stop"), _escaped(F.trim(e)).alias("e"), F.replace("entity_type", F.lit(" "), F.lit("_")).alias("t"), (F.col("annotation_id") if "annotation_id" in df.columns else F.lit(None).cast("string")).alias("a"))
    d = d.withColumn("_no", F.regexp_extract(F.coalesce("a", F.lit("")), r"^T([0-9]{1,9})$", 1).try_cast("int"))
    d = d.withColumn("_no", F.when(F.count("*").over(W.partitionBy("document_id", "_no")) == 1, F.col("_no")))
    w = W.partitionBy("document_id")
    rank = F.row_number().over(w.orderBy(F.col("_no").isNull().desc(), "start", "stop", "t", "e"))
    no = F.coalesce("_no", rank + F.coalesce(F.max("_no").over(w), F.lit(0)))
    return d.select("document_id", F.format_string("T%d\t%s %d %d\t%s", no, "t", "start", "stop", "e").alias("line"))


def brat_coverage_lines(cover: DataFrame, notes: DataFrame) -> DataFrame:
    """document_id, line: the spans of `coverage` that are partial or missed, as brat lines with discontinuous offsets and
    the uncovered text."""
    c = cover.where("coverage <> 'exact'").join(notes, "document_id")
    parts = F.transform(F.split("uncovered", ";"), lambda x: F.struct(F.split(x, " ")[0].cast("int").alias("s"), F.split(x, " ")[1].cast("int").alias("e")))
    text = F.array_join(F.transform(parts, lambda x: F.substring(F.col("text"), x["s"] + 1, x["e"] - x["s"])), " ")
    no = F.row_number().over(W.partitionBy("document_id").orderBy("start", "stop"))
    return c.select("document_id", F.format_string("T%d\t%s %s\t%s", no, F.upper("coverage"), "uncovered", _escaped(text)).alias("line"))


def error_lines(df: DataFrame) -> DataFrame:
    """document_id, line of an error log: the context, then a proposed gold row as CSV."""
    return df.select("document_id", F.concat_ws(",", csv_cell(F.col("context")), F.col("document_id"), F.lit(""), F.col("start").cast("string"), F.col("stop").cast("string"), F.col("entity_type")).alias("line"))


def coloured(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """document_id, shown: the note with its state runs in colour, blanks and line ends inside them as _."""
    x = runs.select("document_id", F.struct("start", "stop", "state").alias("x")).groupBy("document_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    j = notes.join(x, "document_id")
    colour = F.create_map(*[F.lit(v) for kv in COLOURS.items() for v in kv])
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))

    def step(acc: Column, r: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, r["start"] - acc["at"])
        inside = F.translate(F.substring(F.col("text"), r["start"] + 1, r["stop"] - r["start"]), " \r\n", "___")
        return F.struct(F.concat(acc["t"], between, colour[r["state"]], inside, F.lit(END)).alias("t"), r["stop"].alias("at"))

    done = F.aggregate("x", zero, step, lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return j.select("document_id", done.alias("shown"))


def write_chosen(review: DataFrame, folder: str, verdicts: tuple[str, ...] = ("same", "a")) -> None:
    """The reviewed spans of the chosen verdicts as stand-off CSV, with the type of the first annotator that has one."""
    d = review.where(F.col("verdict").isin(*verdicts)).withColumn("entity_type", F.coalesce("type_a", "type_b"))
    write_annotations(d, folder)


def token_lines(tokens: DataFrame) -> DataFrame:
    """document_id, line: each token with its place, to be read by eye."""
    return tokens.select("document_id", F.format_string("%d\t%d\t%d\t%s", "pos", "start", "stop", "entity").alias("line"))
