"""Overlapping and gapped intervals: continuous periods and the gaps between them (problem 4).

Two levels keep a huge entity spread over many tasks. Level one clips every interval into shards of fixed width and
merges within (entity, shard). Level two joins only the islands that touch a shard boundary. The rows of one
(entity, shard) are first reduced to one per distinct start, before the shuffle, so that repeated and skewed rows cost
no more than distinct ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import written

#: Width of a shard in units of start and stop.
SHARD = 4096


def _islands(df: DataFrame, part: list[str]) -> DataFrame:
    """Merge (touching included) the rows of each group `part`, sorted by `_a`; the running maximum stop decides."""
    w = W.partitionBy(*part).orderBy("_a")
    before = F.max("_b").over(w.rowsBetween(W.unboundedPreceding, -1))
    isle = F.sum(F.when(before.isNull() | (F.col("_a") > before), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.select(*part, "_a", "_b", isle.alias("_i")).groupBy(*part, "_i").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_i")


def merged_periods(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", shard: int = SHARD, write: bool = False) -> DataFrame:
    """Continuous periods per entity: columns `keys`, start, stop (bigint).

    Intervals are half-open; overlapping, nested and touching ones merge. Rows with a null end or stop <= start are no
    intervals and are left out. Null keys form entities of their own. Repeated rows change nothing; an empty table
    gives an empty result; extra columns are ignored. An interval over many shards is cut into its two ends and a run
    of whole shards; those runs are merged per entity before they are laid over the shards, so that the rows grow with
    the covered range, not with the number of long intervals. Periods come as `_shard` of their start, too. `write` puts
    the merged shards into the shared folder, for callers that read the periods more than once.
    """
    a, b = F.col(start).cast("bigint"), F.col(stop).cast("bigint")
    names = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    ks = list(names)
    rows = df.select(*[c.alias(n) for n, c in names.items()], a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null and _b > _a")
    rows = rows.select(*ks, "_a", "_b", _shard("_a", shard).alias("_s0"), _shard("_b - 1", shard).alias("_s1"))
    ends = rows.select(
        *ks,
        F.explode(
            F.when(F.col("_s0") == F.col("_s1"), F.array(_piece("_s0", F.col("_a"), F.col("_b")))).otherwise(
                F.array(_piece("_s0", F.col("_a"), (F.col("_s0") + 1) * shard), _piece("_s1", F.col("_s1") * shard, F.col("_b")))
            )
        ).alias("p"),
    ).select(*ks, "p.*")
    runs = rows.where("_s1 > _s0 + 1").groupBy(*ks, (F.col("_s0") + 1).alias("_a")).agg(F.max("_s1").alias("_b"))
    whole = _islands(runs, ks).select(*ks, F.explode(F.sequence("_a", F.col("_b") - 1)).alias("_s"))
    whole = whole.select(*ks, "_s", (F.col("_s") * shard).alias("_a"), ((F.col("_s") + 1) * shard).alias("_b"))
    local = _islands(ends.union(whole).groupBy(*ks, "_s", "_a").agg(F.max("_b").alias("_b")), [*ks, "_s"])
    local = written(local, "islands") if write else local
    touches = (F.col("_a") == F.col("_s") * shard) | (F.col("_b") == (F.col("_s") + 1) * shard)
    stitched = _islands(local.where(touches).select(*ks, "_a", "_b"), ks)
    out = local.where(~touches).select(*ks, "_a", "_b").unionByName(stitched)
    return out.select(*[F.col(n).alias(k) for n, k in zip(ks, keys)], F.col("_a").alias("start"), F.col("_b").alias("stop"), _shard("_a", shard).alias("_shard"))


def _shard(x: str, width: int) -> Column:
    """The number of the shard of `x`, in whole numbers, rounded down for negative ones as well."""
    return F.expr(f"(({x}) - pmod({x}, {width}L)) div {width}L")


def _piece(s: str, a: Column, b: Column) -> Column:
    return F.struct(F.col(s).alias("_s"), a.alias("_a"), b.alias("_b"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", max_gap: int | None = None, shard: int = SHARD) -> DataFrame:
    """Periods and the gaps between consecutive periods: `keys`, kind ('period' or 'gap'), start, stop (of the type of `start`).

    Gaps longer than `max_gap` are left out (None: none are). Within a shard the next period is the next row; over
    shards, one summary row for each (entity, shard) is enough. Edge cases as in `merged_periods`; an entity with one
    period has no gap.
    """
    p = merged_periods(df, keys, start, stop, shard, write=True)
    nxt = F.lead("start").over(W.partitionBy(*keys, "_shard").orderBy("start"))
    fits = lambda a, b: F.lit(True) if max_gap is None else (b - a) <= max_gap
    number = df.schema[start].dataType
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast(number).alias("start"), b.cast(number).alias("stop"))
    here = p.select(*keys, "start", "stop", nxt.alias("_n"))
    both = here.select(
        *keys,
        F.explode(
            F.when(F.col("_n").isNotNull() & fits(F.col("stop"), F.col("_n")), F.array(row("period", F.col("start"), F.col("stop")), row("gap", F.col("stop"), F.col("_n")))).otherwise(
                F.array(row("period", F.col("start"), F.col("stop")))
            )
        ).alias("r"),
    ).select(*keys, "r.*")
    ends = p.groupBy(*keys, "_shard").agg(F.min("start").alias("_f"), F.max("stop").alias("_l"))
    ends = ends.select(*keys, F.col("_l").alias("_a"), F.lead("_f").over(W.partitionBy(*keys).orderBy("_shard")).alias("_b"))
    over = ends.where(F.col("_b").isNotNull() & fits(F.col("_a"), F.col("_b"))).select(*keys, row("gap", F.col("_a"), F.col("_b")).alias("r")).select(*keys, "r.*")
    return both.unionByName(over)


def clean_document_id(c: Column) -> Column:
    """A document id without outer blanks, folder and file ending."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", ""))


def clean_entity_type(c: Column) -> Column:
    """An entity type in upper case without outer blanks and BIO prefix."""
    return F.regexp_replace(F.upper(F.trim(c)), r"^[BI]-", "")


def prediction_periods(predictions: DataFrame, max_gap: int = 300) -> DataFrame:
    """Problem 4 over predictions: whatever the model, per cleaned document_id and entity_type."""
    p = predictions.select(clean_document_id(F.col("document_id")).alias("document_id"), clean_entity_type(F.col("entity_type")).alias("entity_type"), "start", "stop")
    return periods_and_gaps(p, ["document_id", "entity_type"], max_gap=max_gap)
