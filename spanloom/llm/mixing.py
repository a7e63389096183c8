"""Mixing sources to target weights (problem 7).

Tokens are summed per source; from them follow the largest mix in which every source with documents reaches its share
within its repeats, and each source's repetition rate. A document comes out floor(rate) times, and once more if a
seeded hash of its id falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.pieces import clean_name


def mix_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix_name and source: target_share, max_repeats, source_docs, source_tokens, rate, binds (the source whose tokens
    and repeats limit the size of the whole mix).

    Source names are compared in lower case, without outer blanks, with _ for -. Repeated targets of a source add up,
    their least max_repeats holds. A source without documents, tokens, positive share or repeats has rate 0, and the
    shares of the others are scaled up in proportion. `rate` never exceeds max_repeats. Null sources have no target.
    """
    t = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", clean_name(F.col("source")).alias("source"))
    t = t.agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    s = sizes.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("n_tokens").alias("source_tokens"))
    j = t.join(s, "source", "left").na.fill({"source_docs": 0, "source_tokens": 0})
    can = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("source_tokens") > 0)
    w = W.partitionBy("mix_name")
    j = j.withColumn("_share", F.when(can, F.col("target_share") / F.sum(F.when(can, F.col("target_share"))).over(w)))
    j = j.withColumn("_total", F.min(F.when(can, F.col("max_repeats") * F.col("source_tokens") / F.col("_share"))).over(w))
    binds = F.coalesce(can & (F.col("max_repeats") * F.col("source_tokens") / F.col("_share") <= F.col("_total")), F.lit(False))
    rate = F.when(can, F.least(F.col("max_repeats").cast("double"), F.col("_total") * F.col("_share") / F.col("source_tokens"))).otherwise(F.lit(0.0))
    return j.select("mix_name", "source", "target_share", "max_repeats", "source_docs", "source_tokens", rate.alias("rate"), binds.alias("binds"))


def mix_documents(sizes: DataFrame, rates: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row per mix, document and copy: mix_name, source, `key`, copy_no (from 1), n_tokens.

    `sizes`: `key`, source (cleaned), n_tokens. The same key, mix and seed give the same copies on any cluster.
    Documents with a null key, a null source or without tokens are in no mix. The rates are a few rows per mix.
    """
    r = rates.where("rate > 0").select("mix_name", "source", "rate")
    d = sizes.where(F.col(key).isNotNull() & (F.col("n_tokens") > 0)).select(F.col(key).alias("_key"), "source", "n_tokens")
    j = d.join(r, "source")
    draw = F.pmod(F.xxhash64("_key", "mix_name", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    n = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    j = j.withColumn("_n", n).where("_n > 0")
    return j.select("mix_name", "source", F.col("_key").alias(key), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "n_tokens")


def share_report(mixed: DataFrame, rates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per mix and source: the rates' columns, n_docs, n_copies, n_tokens, actual_share, most_repeats."""
    m = mixed.groupBy("mix_name", "source", key).agg(F.count("*").alias("c"), F.sum("n_tokens").alias("t"))
    m = m.groupBy("mix_name", "source").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n_copies"), F.sum("t").alias("n_tokens"), F.max("c").alias("most_repeats"))
    j = rates.join(m, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_copies", "n_tokens", "most_repeats"])
    return j.withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(W.partitionBy("mix_name"))), F.lit(0.0)))
