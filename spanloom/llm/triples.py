"""Words and word runs of notes as hashes, and the digests of their run sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.hashing import digests, flat, lists, run_hashes, word_hashes
from spanloom.session import written

#: Run sets of which a task remembers that it has given their words already.
REMEMBERED = 200_000


def with_words(df: DataFrame, keep: list[str], text: str = "text", n: int = 3, least: Column | None = None, apart: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, `_fit` (the text has at least `least` words and a run), `_n` (distinct runs of `n` words), `_d1` and
    `_d2` (a 128-bit digest of the run set), `_first` and `_w` (the hashes of the words in order). `_first` is true, and
    `_w` is given, only for fit texts whose run set the task has not met before under the same values of `apart`.

    Null texts have no words. Two of m different runs share a 64-bit hash with a probability of about m * m / 2**65.
    """
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                p = b.slice(lo, 2000)
                w, sizes = word_hashes([t or "" for t in p.column(len(keep)).to_pylist()])
                r, of = run_hashes(w, sizes, n)
                fit = (of > 0) & (sizes >= p.column(len(keep) + 1).to_numpy())
                d = digests(r, of)
                first = np.zeros(len(sizes), bool)
                sides = zip(*[p.column(keep.index(c)).to_pylist() for c in apart]) if apart else [()] * len(sizes)
                for i, k in enumerate(zip(*d.T.tolist(), sides)):
                    if fit[i] and k not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(k)
                        first[i] = True
                w = w[np.repeat(first, sizes)].view(np.int64)
                cols = [pa.array(fit), pa.array(of, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(first), lists(w, np.where(first, sizes, 0))]
                yield pa.RecordBatch.from_arrays([*[p.column(i) for i in range(len(keep))], *cols], [*keep, "_fit", "_n", "_d1", "_d2", "_first", "_w"])

    least = F.lit(0) if least is None else least
    return df.select(*keep, F.col(text).alias("_text"), least.cast("int").alias("_least")).mapInArrow(run, f"{schema}, _fit boolean, _n int, _d1 bigint, _d2 bigint, _first boolean, _w array<bigint>")


def bits_of(df: DataFrame, row: str) -> DataFrame:
    """The row numbers (of monotonically_increasing_id) in a column as bitmaps of 4 KB: at most one for 32768 rows of the
    table that was numbered, and one or two for each of its parts."""
    b = df.select(F.bitmap_bucket_number(row).alias("_bucket"), F.bitmap_bit_position(row).alias("_bit"))
    return b.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def in_bits(df: DataFrame, row: str, bits: DataFrame, held: bool = True) -> DataFrame:
    """The rows of `df` whose number is in the bitmaps, or isn't. The rows stay in place."""
    at = f"bitmap_bit_position(`{row}`)"
    byte = f"CAST(conv(hex(substring(_bits, CAST({at} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    hit = F.expr(f"coalesce(shiftright({byte}, CAST({at} % 8 AS INT)) & 1 = 1, false)")
    j = df.withColumn("_bucket", F.bitmap_bucket_number(row)).join(F.broadcast(bits), "_bucket", "inner" if held else "left")
    return j.where(hit if held else ~hit).select(*df.columns)


def classes(words: DataFrame, *apart: str) -> tuple[DataFrame, DataFrame]:
    """Of `with_words`, the classes of fit texts of one run set (and values of `apart`): sets (_id, `apart`, _n, _w), one
    row each, and members (all columns but `_w`, and _id). Only digests are shuffled: the words stay in place, but where
    many tasks have met one set.
    """
    t = written(words.withColumn("_row", F.monotonically_increasing_id()), "words")
    by = [*apart, "_d1", "_d2"]
    ids = written(t.where("_first").groupBy(*by).agg(F.min("_row").alias("_id")), "classes")
    again = written(bits_of(t.where("_first").select(*by, "_row").join(ids, by).where("_row <> _id"), "_row"), "again")
    sets = in_bits(t.where("_first"), "_row", again, False).select(F.col("_row").alias("_id"), *apart, "_n", "_w")
    return sets, t.where("_fit").drop("_w", "_first", "_row").join(ids, by)


def runs_of(sets: DataFrame, n: int) -> DataFrame:
    """(_id, run): the distinct runs of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                p = b.slice(lo, 400)
                w, sizes = flat(p.column(1))
                r, of = run_hashes(w.view(np.uint64), sizes, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p.column(0).to_numpy(), of)), pa.array(r.view(np.int64))], ["_id", "run"])

    return sets.select("_id", "_w").mapInArrow(run, "_id bigint, run bigint")


def shared_runs(wa: pa.Array, wb: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of word lists: runs that both have, runs of the first, runs of the second."""
    (a, sa), (b, sb) = flat(wa), flat(wb)
    (ra, na), (rb, nb) = run_hashes(a.view(np.uint64), sa, n), run_hashes(b.view(np.uint64), sb, n)
    pa_, pb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    h, row = np.concatenate([ra, rb]), np.concatenate([pa_, pb])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    both = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][both], minlength=len(na)), na, nb
