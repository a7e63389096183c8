"""Operators on stand-off spans: merging, algebra, comparison, BIO."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.periods import clean_document_id, clean_entity_type, merged_periods
from spanloom.operators.text import SPACE, TOKEN


def cleaned(df: DataFrame, *more: str) -> DataFrame:
    """document_id, start, stop, entity_type (cleaned) and `more`; rows without both ends or with stop <= start are left out."""
    d = df.where("start IS NOT NULL AND stop > start")
    return d.select(clean_document_id(F.col("document_id")).alias("document_id"), "start", "stop", clean_entity_type(F.col("entity_type")).alias("entity_type"), *more)


def clean_spans(df: DataFrame, *more: str) -> DataFrame:
    """The distinct rows of `cleaned`."""
    return cleaned(df, *more).distinct()


def merge_typed(df: DataFrame, keys: list[str], dist: int = 0, shard: int = 4096) -> DataFrame:
    """Islands by the previous row's stop (not the running maximum): new where start - dist > it; the island's stop is its last row's.

    So nested spans shrink their island. Touching spans merge at dist 0. `merge_union` has the classic rule. Two levels:
    rows are ordered within shards of the text, and a summary of each shard carries the last stop and the number of
    islands on, so a huge document is spread over tasks. Null keys are keys of their own.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for n, k in zip(ks, keys)], "start", "stop", F.floor(F.col("start") / shard).alias("_s"))
    by = [*ks, "_s"]
    other = lambda x: x.select(*[F.col(c).alias(f"{c}_") for c in by], *[c for c in x.columns if c not in by])
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by])
    over = W.partitionBy(*ks).orderBy("_s")
    last = d.groupBy(*ks, "_s").agg(F.max_by("stop", F.struct("start", "stop")).alias("_l"))
    last = last.select(*ks, "_s", F.lag("_l").over(over).alias("_before"))
    w = W.partitionBy(*ks, "_s").orderBy("start", "stop")
    j = d.join(other(last), same).select(*d.columns, "_before")
    prev = F.coalesce(F.lag("stop").over(w), "_before")
    j = j.select(*ks, "_s", "start", "stop", F.when(prev.isNull() | (F.col("start") - dist > prev), 1).otherwise(0).alias("_n"))
    j = j.withColumn("_i", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = j.groupBy(*ks, "_s", "_i").agg(F.min("start").alias("a"), F.max(F.struct("start", "stop")).alias("z"), F.count("*").alias("c"), F.sum("_n").alias("_n"))
    news = part.groupBy(*ks, "_s").agg(F.sum("_n").alias("_m"))
    news = news.select(*ks, "_s", (F.sum("_m").over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")).alias("_p"))
    g = part.join(other(news), same).select(*part.columns, "_p").groupBy(*ks, (F.col("_i") + F.col("_p")).alias("_i"))
    g = g.agg(F.min("a").alias("start"), F.max("z").alias("z"), F.sum("c").alias("n_spans"))
    return g.select(*[F.col(n).alias(k) for n, k in zip(ks, keys)], "start", F.col("z.stop").alias("stop"), "n_spans")


def with_entity(spans: DataFrame, notes: DataFrame, key: str = "document_id") -> DataFrame:
    """The spans with `entity`, their text in the note; a span beyond the note's end is cut there."""
    return spans.join(notes.select(key, F.col("text").alias("_text")), key).withColumn("entity", F.substring("_text", F.col("start") + 1, F.col("stop") - F.col("start"))).drop("_text")


def merged_entity(df: DataFrame, keys: list[str], dist: int = 0) -> DataFrame:
    """As `merge_typed` for spans that come with `entity` but without their note: the entities of an island one after
    another, with a ? for each character between them. An island's spans are in one row, in order."""
    isle = merge_typed(df, keys, dist).withColumnRenamed("start", "a").withColumnRenamed("stop", "b")
    j = df.select(*keys, "start", "stop", "entity").join(isle, keys).where("start >= a AND (start < b OR (start = a AND stop = b) OR stop = b)")
    x = j.groupBy(*keys, "a", "b").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "entity"))).alias("x"))
    zero = F.struct(F.lit("").alias("t"), F.lit(-1).alias("e"))
    gap = lambda acc, r: F.when((acc["e"] >= 0) & (r["start"] > acc["e"]), F.repeat(F.lit("?"), r["start"] - acc["e"])).otherwise("")
    text = F.aggregate("x", zero, lambda acc, r: F.struct(F.concat(acc["t"], gap(acc, r), F.coalesce(r["entity"], F.lit(""))).alias("t"), r["stop"].alias("e")), lambda acc: acc["t"])
    return x.select(*keys, F.col("a").alias("start"), F.col("b").alias("stop"), text.alias("entity"))


def merge_union(df: DataFrame, keys: list[str]) -> DataFrame:
    """Classic union of intervals per key, touching ones merged."""
    return merged_periods(df, keys).select(*keys, F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


#: Characters of a block of the text in which spans meet.
BLOCK = 256


def in_blocks(df: DataFrame, block: int = BLOCK, start: str = "start", stop: str = "stop") -> DataFrame:
    """The spans with `_b`, one row for each block they touch; a span without characters is in none."""
    return df.where(F.col(stop) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(stop) - 1) / block))))


def _meeting(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, ls, le, rs, re): overlapping pairs, each once. Spans meet in blocks of the text, so a long document is many
    small groups; a pair counts in the block in which it begins to overlap."""
    l = in_blocks(a.select(key, F.col("start").alias("ls"), F.col("stop").alias("le")), start="ls", stop="le")
    r = in_blocks(b.select(key, F.col("start").alias("rs"), F.col("stop").alias("re")), start="rs", stop="re")
    j = l.join(r, [key, "_b"]).where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return j.where(F.col("_b") == F.floor(F.greatest("ls", "rs") / BLOCK)).drop("_b")


def overlap(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    """Intersections of two sets of disjoint spans."""
    return _meeting(a, b, key).select(key, F.greatest("ls", "rs").alias("start"), F.least("le", "re").alias("stop"))


def exclude(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    """What `a` covers and `b`, a set of disjoint spans per key, doesn't: key, a, b (the span's ends) and gaps, an array."""
    cuts = F.sort_array(F.collect_list(F.struct(F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"))))
    c = _meeting(a, b, key).groupBy(key, F.col("ls").alias("a"), F.col("le").alias("b")).agg(cuts.alias("c"))
    g = a.select(key, F.col("start").alias("a"), F.col("stop").alias("b")).join(c, [key, "a", "b"], "left")
    gaps = "filter(transform(sequence(0, size(c)), i -> struct(IF(i = 0, a, c[greatest(i - 1, 0)].e) AS start, IF(i = size(c), b, c[least(i, size(c) - 1)].s) AS stop)), x -> x.start < x.stop)"
    gaps = f"IF(c IS NULL, array(struct(a AS start, b AS stop)), {gaps})"
    return g.select(key, "a", "b", F.expr(gaps).alias("gaps"))


def state_runs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Maximal runs of characters of one state: tp (in gold and predictions), fn (gold only), fp (predictions only)."""
    g, p = merge_union(gold, ["document_id"]), merge_union(pred, ["document_id"])
    only = lambda a, b, state: exclude(a, b).select("document_id", F.inline("gaps")).withColumn("state", F.lit(state))
    return overlap(g, p).withColumn("state", F.lit("tp")).unionByName(only(g, p, "fn")).unionByName(only(p, g, "fp"))


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each gold span against the union of predictions: exact (wholly covered), missed or partial, with the uncovered parts."""
    e = exclude(gold.select("document_id", "start", "stop").distinct(), merge_union(pred, ["document_id"]))
    parts = F.array_join(F.transform("gaps", lambda x: F.concat_ws(" ", x["start"].cast("string"), x["stop"].cast("string"))), ";")
    kind = F.when(F.size("gaps") == 0, "exact").when(F.expr("size(gaps) = 1 AND gaps[0].start = a AND gaps[0].stop = b"), "missed").otherwise("partial")
    return e.select("document_id", F.col("a").alias("start"), F.col("b").alias("stop"), kind.alias("coverage"), parts.alias("uncovered"))


def token_flags(tokens: DataFrame, gold: DataFrame, pred: DataFrame, block: int = 256) -> DataFrame:
    """Tokens of documents with gold, with in_gold and in_pred (any character inside a span).

    Tokens meet the merged spans in blocks of the text: the spans of one block are a short list, whatever the document's
    length, and documents without gold are left out first.
    """
    ids = gold.select("document_id").distinct()
    side = lambda x, n: in_blocks(merge_union(x, ["document_id"]), block).groupBy("document_id", "_b").agg(F.collect_set(F.struct("start", "stop")).alias(n))
    t = tokens.join(ids, "document_id", "left_semi")
    t = in_blocks(t.select("document_id", "start", "stop", "entity"), block)
    j = t.join(side(gold, "g"), ["document_id", "_b"], "left").join(side(pred.join(ids, "document_id", "left_semi"), "q"), ["document_id", "_b"], "left")
    hit = lambda n: F.bool_or(F.expr(f"coalesce(exists({n}, x -> x.start < stop AND x.stop > start), false)"))
    return j.groupBy("document_id", "start", "stop", "entity").agg(hit("g").alias("in_gold"), hit("q").alias("in_pred"))


def flagged_tokens(notes: DataFrame, gold: DataFrame, pred: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """document_id, start, stop, entity, in_gold, in_pred, n_split: the tokens of notes with gold as in `token_flags`, and
    the number of tokens that single white space signs split the note into.

    The merged spans of a note, disjoint and so bounded by its length, come to it as two sorted lists, and its tokens
    are looked up in them; only notes and spans are shuffled, no tokens. Notes without tokens have no rows.
    """
    rx, space = re.compile(pattern), re.compile(f"[{SPACE}]")
    ids = gold.select("document_id").distinct()
    side = lambda x, n: merge_union(x, ["document_id"]).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(n))
    none = F.array().cast("array<struct<start: int, stop: int>>")
    d = notes.where("text IS NOT NULL").join(side(gold, "g"), "document_id").join(side(pred.join(ids, "document_id", "left_semi"), "q"), "document_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [rx.findall(t) for t in texts]
            n = np.array([len(x) for x in found], np.int64)
            stop = np.array([m.end() for t in texts for m in rx.finditer(t)], np.int64)
            words = [w for x in found for w in x]
            start = stop - np.fromiter(map(len, words), np.int64, len(words))
            row = np.repeat(np.arange(len(texts)), n)
            far = np.int64(1) << 32
            flags = []
            for c in (b.column(2), b.column(3)):
                ends = c.offsets.to_numpy()
                x = c.flatten()
                own = np.repeat(np.arange(len(texts)), np.diff(ends)) * far
                lo, hi = (own + x.field(k).to_numpy() for k in ("start", "stop"))
                i = np.searchsorted(hi, row * far + start, side="right")
                hit = i < len(lo)
                hit[hit] = lo[i[hit]] < (row * far + stop)[hit]
                flags.append(pa.array(hit))
            split = pa.array(np.array([len(space.findall(t)) + 1 for t in texts], np.int64)[row])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(words, pa.string()), *flags, split], ["document_id", "start", "stop", "entity", "in_gold", "in_pred", "n_split"])

    kt = notes.schema["document_id"].dataType.simpleString()
    return d.select("document_id", "text", "g", F.coalesce("q", none).alias("q")).mapInArrow(run, f"document_id {kt}, start int, stop int, entity string, in_gold boolean, in_pred boolean, n_split bigint")


def bio_split(spans: DataFrame, words: DataFrame) -> DataFrame:
    """One row per word or sign inside a span: B- for its first, I- for further ones. A span and a word meet in the block
    in which the word starts."""
    s = in_blocks(spans.select("document_id", "entity_type", F.col("start").alias("_s"), F.col("stop").alias("_e")), start="_s", stop="_e")
    w = words.select("document_id", "start", "stop", F.floor(F.col("start") / BLOCK).alias("_b"))
    j = s.join(w, ["document_id", "_b"]).where("start >= _s AND stop <= _e")
    first = F.row_number().over(W.partitionBy("document_id", "entity_type", "_s", "_e").orderBy("start")) == 1
    return j.select("document_id", F.concat(F.when(first, "B-").otherwise("I-"), "entity_type").alias("label"), "start", "stop")


def bio_merge(labels: DataFrame) -> DataFrame:
    """Entities from B-/I- rows: an entity runs from a B- row to before the next; leading I- rows are dropped."""
    w = W.partitionBy("document_id").orderBy("start", "stop", "label")
    d = labels.withColumn("_i", F.sum(F.col("label").startswith("B-").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_i > 0")
    last = F.struct("start", "stop", "label")
    return d.groupBy("document_id", "_i").agg(F.min("start").alias("start"), F.max_by("stop", last).alias("stop"), F.min_by(F.expr("substring(label, 3)"), last).alias("entity_type")).drop("_i")
