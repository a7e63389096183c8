"""Redaction of a stream of notes: the row-local operators run unchanged on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.text import RULES, redact_pattern


def redact_stream(notes: DataFrame, text: str = "text") -> DataFrame:
    """The notes with `redacted` beside them; stateless, so any output mode and trigger will do."""
    return notes.withColumn("redacted", redact_pattern(F.col(text), "|".join(RULES.values())))


def mentions_per_window(notes: DataFrame, at: str = "loaded_at", text: str = "text", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Rule mentions per time window and type; rows later than `late` behind the watermark are left to batch runs."""
    n = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("n")) for k, p in RULES.items()])
    d = notes.withWatermark(at, late).select(F.col(at), F.explode(n).alias("x"))
    return d.groupBy(F.window(at, window), F.col("x.entity_type").alias("entity_type")).agg(F.sum("x.n").alias("n_mentions"))
