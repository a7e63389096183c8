"""Notes of evaluation splits that occur, wholly or nearly, in training notes (problem 3).

Edit-distance segment join. A match may miss k of an evaluation note's distinct word runs. The note is cut into k+c
segments, one around each of its k+c runs that are least frequent among the training notes: of any match c segments are
hit by no miss, so their runs are in the training note, at any position. Pairs that meet c times are verified by a
dynamic programme in a band around their common diagonal: d word edits spoil at most n*d runs of n words, so a pair
with n*d <= k is a match by the band's verdict alone. Pairs the band can't decide (moved blocks, repeated runs) are
counted exactly on their full run sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.hashing import flat
from spanloom.llm.triples import classes, runs_of, shared_runs, with_words
from spanloom.session import written

#: The band of the dynamic programme on either side of the diagonal is this share of the evaluation note's words, at least MIN_BAND.
BAND_SHARE, MIN_BAND = 0.25, 8
#: c of the segment join. With 1, any rare run that two notes share by chance makes a pair to check.
PROBES = 4
#: Cells of the dynamic programme worked on at once.
CELLS = 40_000
FAR = 1 << 20


def clean_split(c: Column) -> Column:
    """A split name in lower case without outer blanks, with _ for -; dev for val."""
    s = F.lower(F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("-"), F.lit("_")))
    return F.when(s == "val", "dev").otherwise(s)


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Of each pair (a, b): the edits that turn the word sequence `a` into some stretch of `b`, start and end free, on a
    path within `band` of diagonal `at`; -1 where no path lies in the band. Pairs of like length go through together.
    """
    out = np.full(len(pairs), -1, np.int32)
    n = np.array([len(a) for a, _ in pairs], np.int64)
    order = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * (2 * int(band[order[lo : hi + 1]].max()) + 1) <= CELLS:
            hi += 1
        part, lo = order[lo:hi], hi
        half = int(band[part].max())
        width, most = 2 * half + 1, int(n[part].max())
        aa = np.full((len(part), most), -2, np.int64)
        bb = np.full((len(part), most + width), -1, np.int64)  # bb[p, x] = b[at - half - 1 + x]
        first, last = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        for p, i in enumerate(part):
            a, b = pairs[i]
            aa[p, : len(a)] = a
            x0 = half + 1 - int(at[i])
            s, e = max(0, x0), min(bb.shape[1], x0 + len(b))
            if s < e:
                bb[p, s:e] = b[s - x0 : e - x0]
            first[p], last[p] = x0 - 1, x0 - 1 + len(b)  # x of columns 0 and len(b)
        offs = np.arange(width)
        beyond = np.where(np.abs(offs - half)[None] > band[part][:, None], FAR, 0)
        row = np.where((offs >= first[:, None]) & (offs <= last[:, None]), 0, FAR) + beyond
        for i in range(1, most + 1):
            take = row + (bb[:, i : i + width] != aa[:, i - 1 : i])
            take[:, :-1] = np.minimum(take[:, :-1], row[:, 1:] + 1)
            x = offs + i
            bad = ((x < first[:, None]) | (x > last[:, None])) * FAR + beyond
            take += bad
            row = np.minimum.accumulate(take - offs, axis=1) + offs + bad
            done = n[part] == i
            if done.any():
                low = row[done].min(axis=1)
                out[part[done]] = np.where(low < FAR // 2, low, -1)
            np.minimum(row, 4 * FAR, out=row)
    return out


def _diagonal(a: np.ndarray, b: np.ndarray) -> int:
    """The median of b's place minus a's over the words that both have once."""
    (x, ia, ca), (y, ib, cb) = (np.unique(v, return_index=True, return_counts=True) for v in (a, b))
    x, ia, y, ib = x[ca == 1], ia[ca == 1], y[cb == 1], ib[cb == 1]
    if not len(x) or not len(y):
        return 0
    k = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[k] == x
    return int(np.median(ib[k[same]] - ia[same])) if same.any() else 0


def _verdicts(batches: Iterator[pa.RecordBatch], n: int, contained: float) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for lo in range(0, x.num_rows, 1000):
            p = x.slice(lo, 1000)
            (a, sa), (b, sb) = flat(p.column(2)), flat(p.column(3))
            m = p.column(4).to_numpy().astype(np.int64)
            ends_a, ends_b = np.cumsum(sa), np.cumsum(sb)
            pairs = [(a[i - s : i], b[j - t : j]) for i, s, j, t in zip(ends_a, sa, ends_b, sb)]
            edits = np.array([0 if len(u) == len(v) and (u == v).all() else -1 for u, v in pairs], np.int32)
            todo = np.flatnonzero(edits)
            if len(todo):
                at = np.array([_diagonal(*pairs[i]) for i in todo])
                edits[todo] = banded_distances([pairs[i] for i in todo], at, np.maximum(MIN_BAND, (sa[todo] * BAND_SHARE).astype(np.int64)))
            missed = m - np.ceil(m * contained - 1e-9).astype(np.int64)
            match = (edits >= 0) & (n * edits <= missed)
            rest = np.flatnonzero(~match)
            if len(rest):
                q = p.take(pa.array(rest))
                both, own, _ = shared_runs(q.column(2), q.column(3), n)
                match[rest] = both >= own - missed[rest]
            keep = pa.array(match)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(edits)], ["ea", "tb", "edits"]).filter(keep)


def _met(ev: DataFrame, tr: DataFrame, n: int, contained: float) -> DataFrame:
    """(ea, tb, m) that agree in at least c of the k+c probes of the evaluation note; m: its distinct runs."""
    grams = runs_of(tr, n).select(F.col("_id").alias("tb"), "run")
    # frequencies only rank the probes, so 31 bits of a run will do; a run that both sides have counts 1 at least
    low = F.shiftrightunsigned("run", 33).cast("int")
    often = grams.groupBy(low.alias("low")).agg(F.count("*").alias("df"))
    # a probe is one number: the frequency on a scale of 1/32 of its logarithm, then 52 bits of the run
    high = F.shiftrightunsigned("run", 12)
    rank = F.shiftleft(F.floor(F.log2(F.coalesce("df", F.lit(0)) + 1) * 32).cast("bigint"), 52)
    segs = runs_of(ev, n).join(often, low == F.col("low"), "left").select(F.col("_id").alias("ea"), (rank + high).alias("x"))
    ranked = segs.groupBy("ea").agg(F.sort_array(F.collect_list("x")).alias("o")).withColumn("m", F.size("o"))
    k = F.col("m") - F.ceil(F.col("m") * contained - 1e-9)
    first = F.filter(F.slice("o", 1, (k + PROBES).cast("int")), lambda x: x >= 1 << 52)
    probe = ranked.select("ea", "m", F.least(F.lit(PROBES), F.col("m") - k).alias("least"), F.explode(first).alias("x"))
    probe = probe.select("ea", "m", "least", F.col("x").bitwiseAND(F.lit((1 << 52) - 1)).alias("high"))
    met = probe.join(grams.select("tb", high.alias("high")), "high")
    return met.groupBy("ea", "tb", "m", "least").agg(F.count("*").alias("c")).where("c >= least").select("ea", "tb", "m")


def split_links(df: DataFrame, key: str = "guid", text: str = "text", split: str = "split", train: str = "train", evaluation: tuple[str, ...] = ("dev", "test"), contained: float = 0.8, n: int = 5, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links between classes of notes, and the members of the classes.

    Links: ea, tb, edits: a class of evaluation notes whose distinct runs of `n` words are, by at least the share
    `contained`, runs of the class tb of training notes. edits: word edits that turn a note of ea into a stretch of one
    of tb along a band; -1 where no path lies in the band. Members: _key, _id, _train: notes of one side and run set are one
    class.

    Evaluation notes under `least_words` words or without a run, null keys, null texts and other splits are left out;
    repeated rows count once. Other columns are ignored; empty tables give no rows. No candidate is dropped.
    """
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), clean_split(F.col(split)).alias("_split"))
    d = d.where(F.col("_split").isin(train, *evaluation)).select("_key", "_text", (F.col("_split") == train).alias("_train"))
    least = F.when(F.col("_train"), 0).otherwise(least_words)
    sets, members = classes(with_words(d, ["_key", "_train"], "_text", n, least, ("_train",)), "_train")
    ev, tr = sets.where("NOT _train"), sets.where("_train")
    met = _met(ev, tr, n, contained)
    words = lambda s, name: s.select(F.col("_id").alias(name), F.col("_w").alias(f"w{name}"))
    both = met.join(words(ev, "ea"), "ea").join(words(tr, "tb"), "tb").select("ea", "tb", "wea", "wtb", "m")
    links = written(both.mapInArrow(lambda it: _verdicts(it, n, contained), "ea bigint, tb bigint, edits int"), "links")
    return links, members.select("_key", "_id", "_train").distinct()


def split_overlaps(df: DataFrame, **how: object) -> DataFrame:
    """One row per (evaluation key, training key): eval_key, train_key, edits. Arguments and edge cases as in
    `split_links`; a key may be on both sides, but no key is paired with itself."""
    links, members = split_links(df, **how)
    e = members.where("NOT _train").select(F.col("_id").alias("ea"), F.col("_key").alias("eval_key")).distinct()
    t = members.where("_train").select(F.col("_id").alias("tb"), F.col("_key").alias("train_key")).distinct()
    return links.join(e, "ea").join(t, "tb").where("eval_key <> train_key").select("eval_key", "train_key", "edits")


def overlap_counts(df: DataFrame, **how: object) -> DataFrame:
    """One row per evaluation key with a link: eval_key, n_links (training keys other than itself), unchanged (some
    training note has all its words in order). Counted by class, without the pairs. Arguments as in `split_links`.
    """
    links, members = split_links(df, **how)
    e = members.where("NOT _train").select(F.col("_id").alias("ea"), F.col("_key").alias("eval_key")).distinct()
    t = members.where("_train").select(F.col("_id").alias("tb"), F.col("_key").alias("train_key")).distinct()
    n = links.join(t.groupBy("tb").agg(F.count("*").alias("c")), "tb").groupBy("ea").agg(F.sum("c").alias("c"), F.max((F.col("edits") == 0).cast("int")).alias("same"))
    # a key that is on both sides isn't its own link
    self = links.join(t, "tb").join(e.select("ea", F.col("eval_key").alias("train_key")), ["ea", "train_key"]).groupBy("ea", F.col("train_key").alias("eval_key")).agg(F.count("*").alias("own"))
    j = e.join(n, "ea").join(self, ["ea", "eval_key"], "left").na.fill(0, ["own"])
    j = j.groupBy("eval_key").agg(F.sum(F.col("c") - F.col("own")).alias("n_links"), F.max("same").alias("unchanged"))
    return j.where("n_links > 0")
