"""Scans of notes, stand-off annotations, predictions and score tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a stand-off annotation file.
ANNOTATION = "document_id string, annotation_id string, start int, stop int, entity string, entity_type string, comment string"
REQUIRED = ("entity_type", "entity")


def _stem() -> Column:
    return F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"%20", " "), r"\.[^.]*$", "")


def read_notes(spark: SparkSession, folder: str, ending: str | None = ".txt") -> DataFrame:
    """One row per file: document_id (file name without ending), text (the whole file). All endings if `ending` is None."""
    r = spark.read
    if ending:
        r = r.option("pathGlobFilter", f"*{ending}")
    return r.text(folder, wholetext=True).select(_stem().alias("document_id"), F.col("value").alias("text"))


def inline_note(spark: SparkSession, text: str, document_id: str = "0") -> DataFrame:
    """A note given as a string."""
    return spark.createDataFrame([(document_id, text)], "document_id string, text string")


def read_note_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the columns row_id and text, texts over several lines included: document_id, text."""
    d = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return d.select(F.col("row_id").cast("string").alias("document_id"), "text")


def csv_rows(spark: SparkSession, folder: str, ending: str = ".csv", sep: str = ",", quote: str = '"') -> DataFrame:
    """Rows of CSV or TSV files: file_path, file_stem, row (map from the names in the file's own header to values).

    Each file is read by its own header, so files of one folder may differ in columns and order. A file is one
    document's annotations and is parsed whole by one task. Empty files have no rows.
    """
    r = spark.read.option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
    files = r.select(F.col("_metadata.file_path").alias("file_path"), _stem().alias("file_stem"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for path, stem, text in zip(p["file_path"], p["file_stem"], p["value"]):
                for row in csv.DictReader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote):
                    out.append((path, stem, {k.strip(): v for k, v in row.items() if k is not None and v is not None}))
            yield pd.DataFrame(out, columns=["file_path", "file_stem", "row"])

    return files.mapInPandas(run, "file_path string, file_stem string, row map<string,string>")


def _annotations(rows: DataFrame, *more: Column) -> DataFrame:
    get = lambda k: F.nullif(F.try_element_at("row", F.lit(k)), F.lit(""))
    number = lambda k: get(k).try_cast("int")
    d = rows.select(
        F.coalesce(get("document_id"), "file_stem").alias("document_id"),
        get("annotation_id").alias("annotation_id"),
        F.coalesce(number("start"), number("offset")).alias("start"),
        number("stop").alias("_stop"),
        number("length").alias("_length"),
        *[F.when(F.map_contains_key("row", F.lit(k)), F.try_element_at("row", F.lit(k))).alias(k) for k in ("entity", "entity_type")],
        get("comment").alias("comment"),
        *more,
    )
    d = d.withColumn("stop", F.coalesce("_stop", F.col("start") + F.col("_length"))).withColumn("length", F.col("stop") - F.col("start"))
    names = [c.split()[0] for c in ANNOTATION.split(", ")]
    return d.select(*names, "length", *[c for c in d.columns if c not in (*names, "length", "_stop", "_length")])


def read_annotations(spark: SparkSession, folder: str, ending: str = ".gs", sep: str = ",") -> DataFrame:
    """Stand-off CSV files, each with its own header in any order: the columns of ANNOTATION and length.

    `offset` stands for start; stop is start + length where only that is given; document_id falls back on the file name.
    A number that is none is null. Columns a file lacks are null.
    """
    return _annotations(csv_rows(spark, folder, ending, sep))


def read_models(spark: SparkSession, root: str, ending: str = ".pred") -> DataFrame:
    """Prediction files below `root`/<model>/: as `read_annotations`, and model_name from the folder."""
    rows = csv_rows(spark, f"{root}/*/", ending)
    return _annotations(rows, F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("model_name"))


def complete_models(predictions: DataFrame, notes: DataFrame) -> DataFrame:
    """model_name, n_missing, n_unknown: notes that a model has no prediction of, and its documents that are no notes."""
    ids = notes.select("document_id").distinct()
    p = predictions.select("model_name", "document_id").distinct()
    known = p.join(ids, "document_id", "left_semi").groupBy("model_name").agg(F.count("*").alias("n"))
    every = p.groupBy("model_name").agg(F.count("*").alias("m")).join(known, "model_name", "left").na.fill(0, ["n"])
    total = F.broadcast(ids.agg(F.count("*").alias("t")))  # one row
    return every.crossJoin(total).select("model_name", (F.col("t") - F.col("n")).alias("n_missing"), (F.col("m") - F.col("n")).alias("n_unknown"))


def read_probabilities(spark: SparkSession, folder: str, ending: str = ".prob") -> DataFrame:
    """Token probability files: document_id, token, label_id, probs (map label -> probability)."""
    rows = csv_rows(spark, folder, ending)
    rest = F.map_filter("row", lambda k, v: ~k.isin("token", "label_id"))
    return rows.select(F.col("file_stem").alias("document_id"), F.col("row")["token"].alias("token"), F.col("row")["label_id"].try_cast("int").alias("label_id"), F.transform_values(rest, lambda k, v: v.try_cast("double")).alias("probs"))


def labelled_notes(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Notes of `root`[/split]/txt with the annotations of `root`[/split]/ann; notes without annotations are kept."""
    if split is not None and split not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {split!r}")
    at = f"{root}/{split}" if split else root
    a = read_annotations(spark, f"{at}/ann").drop("comment")
    d = read_notes(spark, f"{at}/txt").join(a, "document_id", "left")
    return d.withColumn("split", F.lit(split)) if split else d


def labels_from_rows(spark: SparkSession, rows: list[tuple[str, str, int, int, str]]) -> DataFrame:
    """Labels given in memory as (document_id, entity_type, start, length, entity); other shapes raise TypeError."""
    for r in rows:
        if len(r) != 5 or not isinstance(r[1], str) or isinstance(r[2], bool) or not isinstance(r[2], int) or not isinstance(r[3], int) or not isinstance(r[4], str):
            raise TypeError(f"no label: {r!r}")
    d = spark.createDataFrame(rows, "document_id string, entity_type string, start int, length int, entity string")
    return d.withColumn("stop", F.col("start") + F.col("length"))


def annotator_pairs(notes: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """document_id, text, a, b: each note with its spans by two annotators; notes that lack one of them are left out."""
    side = lambda x, n: x.groupBy("document_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "entity_type"))).alias(n))
    return notes.select("document_id", "text").join(side(a, "a"), "document_id").join(side(b, "b"), "document_id")


def read_config(path: str) -> dict[str, object]:
    """A run configuration in JSON; a missing task or data_type raises ValueError."""
    c = json.loads(Path(path).read_text())
    for k in ("data_type",):
        if k not in c and "task_type" not in c:
            raise ValueError(f"{path} has no {k}")
    return c


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The parquet table at `path`, built and written first where there is none (features, predictions)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
