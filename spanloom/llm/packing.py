"""Filling fixed-capacity containers with documents (problem 6).

Shortest-pack-first over the length histogram (Krell et al., 2021). Only the histogram, whose size is bounded by the
capacities, reaches the driver. There, whole groups of equal packs take whole counts of equal lengths, longest first,
each time into the packs that are least full. The plan says which ranks of a length go to which packs; documents find
their pack by their rank among those of their length. Ranks are counted within the part of the table that one task
wrote, so that a hot length is ranked by many tasks. Full pieces of oversized documents need no rank and no plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import written

#: Most rows of a plan that are broadcast; a larger plan is joined.
PLAN_ROWS = 1_000_000


def plan_packs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """[(length, rank_lo, rank_hi, first_pack)], number of packs.

    Of the documents of a length, those ranked [rank_lo, rank_hi) go to the packs from first_pack on, one to each; a pack
    may take the same length in several rounds. Lengths are from 1 to `capacity`.
    """
    heap: list[tuple[int, int, int]] = []  # (-free, first pack, packs)
    plan: list[tuple[int, int, int, int]] = []
    packs = 0
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        rank, left = 0, histogram[length]
        moved = []
        while left:
            if heap and -heap[0][0] >= length:
                free, first, count = heapq.heappop(heap)
                free = -free
                m = min(left, count)
                if m < count:
                    heapq.heappush(heap, (-free, first + m, count - m))
            else:
                if moved:  # packs filled in this round may take a document of this length again
                    for x in moved:
                        heapq.heappush(heap, x)
                    moved = []
                    if heap and -heap[0][0] >= length:
                        continue
                # only as many packs as the rest of this length fills; its next rounds go to them again
                free, first, count = capacity, packs, -(-left // (capacity // length))
                packs += count
                heapq.heappush(heap, (-free, first, count))
                continue
            plan.append((length, rank, rank + m, first))
            if free > length:
                moved.append((-(free - length), first, m))
            rank, left = rank + m, left - m
        for x in moved:
            heapq.heappush(heap, x)
    return plan, packs


def joined_rounds(plan: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """[(length, rank_lo, rank_hi, first_pack, width)]: rounds of one length over the same packs as one row, in which
    rank r goes to pack first_pack + (r - rank_lo) % width. A hot short length has thousands of such rounds.
    """
    out: list[tuple[int, int, int, int, int]] = []
    for length, lo, hi, first in plan:
        if out:
            n, start, stop, at, width = out[-1]
            if n == length and stop == lo and at == first and (stop - start) % width == 0 and hi - lo <= width:
                out[-1] = (n, start, hi, at, width)
                continue
        out.append((length, lo, hi, first, hi - lo))
    return out


def _placed(batches: Iterator[pa.RecordBatch], hi: np.ndarray, lo: np.ndarray, first: np.ndarray, width: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Adds container_no by the sorted ends `hi` of the plan's rank ranges, which are numbered over specs and lengths."""
    for b in batches:
        spec, n, r = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
        at = (spec * most + n << 40) + r
        i = np.searchsorted(hi, at, side="right")
        no = first[i] + (at - lo[i]) % width[i]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[3:], pa.array(no)], [b.schema.names[0], "n", *b.schema.names[3:], "container_no"])


def pack_documents(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens", plan_rows: int = PLAN_ROWS) -> DataFrame:
    """One row per container spec and piece: container_name, capacity_tokens, container_no (from 0), `key`, piece_no,
    token_start, n_tokens.

    A document over the capacity is cut into pieces of exactly the capacity and one rest; others are never split. Full
    pieces have the first containers. Documents without tokens are spread over all containers (container 0 if there is
    none). Every row of `sizes` is packed, repeated keys as separate documents; rows with a null key or size are left
    out. Specs with a null or non-positive capacity are left out, repeated specs count once; `specs` is a small fixed
    table and is read by the driver. An empty table gives an empty result.
    """
    spark = sizes.sparkSession
    caps = sorted({(r[0], int(r[1])) for r in specs.select("container_name", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0}, key=str)
    key_type = sizes.schema[key].dataType.simpleString()
    if not caps:
        return spark.createDataFrame([], f"container_name string, capacity_tokens int, container_no bigint, `{key}` {key_type}, piece_no int, token_start bigint, n_tokens int")
    d = sizes.where(F.col(key).isNotNull() & F.col(size).isNotNull())
    d = written(d.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_n"), F.monotonically_increasing_id().alias("_row")), "sizes")
    spec = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).alias("cap")) for i, (_, c) in enumerate(caps)])
    p = d.select("_key", "_n", "_row", F.shiftright("_row", 33).cast("int").alias("part"), F.explode(spec).alias("s")).select("_key", "_n", "_row", "part", "s.*")
    p = p.withColumn("full", F.expr("_n div cap")).withColumn("n", F.expr("cast(_n % cap AS int)"))
    counts = written(p.groupBy("spec", "n", "part").agg(F.count("*").alias("c"), F.sum("full").alias("full")), "counts")
    hist: list[dict[int, int]] = [{} for _ in caps]
    base = [0] * len(caps)  # full containers
    for i, n, c, full in counts.groupBy("spec", "n").agg(F.sum("c"), F.sum("full")).collect():  # at most the sum of the capacities
        hist[i][n] = c
        base[i] += full
    rows, total = [], []
    for i, ((_, cap), h) in enumerate(zip(caps, hist)):
        plan, packs = plan_packs({n: c for n, c in h.items() if n}, cap)
        rows += [(i, n, lo, hi, base[i] + first, width) for n, lo, hi, first, width in joined_rounds(plan)]
        total.append(max(1, base[i] + packs))
    of = W.partitionBy("spec", "n").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    before = counts.where("n > 0").select("spec", "n", "part", (F.sum("c").over(of) - F.col("c")).alias("before"))
    ranked = p.where("n > 0").withColumn("r", F.row_number().over(W.partitionBy("spec", "n", "part").orderBy("_row")) - 1).join(before, ["spec", "n", "part"])
    ranked = ranked.select("spec", "n", (F.col("r") + F.col("before")).alias("r"), "_key", F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("cap")).alias("token_start"))
    cols = ["spec", "n", "_key", "piece_no", "token_start", "container_no"]
    if rows and len(rows) <= plan_rows:
        most = max(c for _, c in caps) + 1
        plan = np.array(sorted(rows, key=lambda x: (x[0], x[1], x[2])), np.int64)
        at = plan[:, 0] * most + plan[:, 1] << 40
        arrays = spark.sparkContext.broadcast((at + plan[:, 3], at + plan[:, 2], plan[:, 4], plan[:, 5]))
        rest = ranked.mapInArrow(lambda it: _placed(it, *arrays.value, most), f"spec int, n int, _key {key_type}, piece_no int, token_start bigint, container_no bigint")
    else:
        plan = spark.createDataFrame(rows, "spec int, n int, lo bigint, hi bigint, first bigint, width bigint")
        rest = ranked.join(plan, ["spec", "n"]).where("r >= lo AND r < hi").withColumn("container_no", F.expr("first + (r - lo) % width")).select(*cols)
    # full pieces: containers by running totals of their numbers
    part = counts.groupBy("spec", "part").agg(F.sum("full").alias("f"))
    part = part.select("spec", "part", (F.sum("f").over(W.partitionBy("spec").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("f")).alias("before"))
    f = p.where("full > 0").withColumn("r", F.sum("full").over(W.partitionBy("spec", "part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)) - F.col("full"))
    f = f.join(part, ["spec", "part"]).select("spec", F.col("cap").alias("n"), "_key", (F.col("r") + F.col("before")).alias("first"), F.explode(F.expr("sequence(0, cast(full - 1 AS int))")).alias("piece_no"))
    f = f.select("spec", "n", "_key", "piece_no", (F.col("piece_no").cast("bigint") * F.col("n")).alias("token_start"), (F.col("first") + F.col("piece_no")).alias("container_no"))
    all_ = F.element_at(F.array(*[F.lit(x) for x in total]), F.col("spec") + 1)
    none = p.where("_n = 0").select("spec", F.lit(0).alias("n"), "_key", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("token_start"), F.pmod(F.xxhash64("_key", "_row"), all_.cast("bigint")).alias("container_no"))
    names = F.array(*[F.lit(x) for x, _ in caps])
    sized = F.array(*[F.lit(c) for _, c in caps])
    out = rest.select(*cols).unionByName(f.select(*cols)).unionByName(none.select(*cols))
    return out.select(F.element_at(names, F.col("spec") + 1).alias("container_name"), F.element_at(sized, F.col("spec") + 1).alias("capacity_tokens"), "container_no", F.col("_key").alias(key), "piece_no", "token_start", F.col("n").alias("n_tokens"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container spec: n_containers, n_pieces, n_tokens, fill (the used part of all room)."""
    one = packed.groupBy("container_name", "capacity_tokens", "container_no").agg(F.count("*").alias("p"), F.sum("n_tokens").alias("t"))
    g = one.groupBy("container_name", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    return g.withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
