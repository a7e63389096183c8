"""Near-duplicate notes by MinHash banding (problem 2).

Notes with equal run sets are one representative. Its signature is cut into bands; representatives that agree in a band
meet in a bucket. No bucket is expanded into all its pairs: first every member is verified against the bucket's least
member, then only members of one bucket that are still in different components are verified against each other. In a
bucket of over `HOT` members only those pairs are tried that a prefix filter on rare runs leaves. That finds the same
components as all pairs would.

A pair is tried on sketches of its sets first, 128 bytes each, which can only rule out what is below the similarity; the
words of a set are sent on for pairs that are left. The more notes, the more of them meet by chance, so what is sent
for pairs and runs is sent in rounds, as many as keep a round in proportion to the number of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.components import connected_components
from spanloom.llm.hashing import flat, lists, run_hashes
from spanloom.llm.triples import bits_of, classes, in_bits, runs_of, shared_runs, with_words
from spanloom.session import dropped, written

BANDS, ROWS, SEED = 27, 3, 20240229
#: A bucket with more members is not joined with itself; a run is rare if at most RARE notes of such buckets have it.
HOT, RARE = 64, 32
#: Longs of a sketch: a bit for each run of a set, by its hash.
SKETCH = 16


def recall_at(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def band_hashes(runs: np.ndarray, sizes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, (len(sizes), bands) int64, of non-empty sets of 64-bit hashes laid end to end."""
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    x = runs ^ (runs >> np.uint64(31))
    at = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            h = np.full(len(sizes), np.uint64(k + 1))
            for i in range(k * rows, (k + 1) * rows):
                h = (h ^ np.minimum.reduceat(x * mul[i] + add[i], at)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, k] = h
    return out.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 400):
            part = b.slice(lo, 400)
            w, sizes = flat(part.column(2))
            h = band_hashes(*run_hashes(w.view(np.uint64), sizes, n), bands, rows)
            again = lambda i: pa.array(np.repeat(part.column(i).to_numpy(), bands))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), again(0), again(1)], ["h", "id", "n"])


def _sketches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 400):
            part = b.slice(lo, 400)
            w, sizes = flat(part.column(2))
            r, of = run_hashes(w.view(np.uint64), sizes, n)
            with np.errstate(over="ignore"):
                bit = ((r * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * SKETCH)
            bits = np.zeros((part.num_rows, 64 * SKETCH), bool)
            bits[np.repeat(np.arange(part.num_rows), of), bit.astype(np.int64)] = True
            s = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(s.ravel(), np.full(len(s), SKETCH))], ["id", "n", "s"])


def _in_rounds(amount: int, room: int, part: Callable[[Callable[[str], Column]], DataFrame], tag: str) -> DataFrame:
    """The union of `part` for each round, written; as many rounds as `room` goes into `amount`. `part` gets a function
    that gives the condition by which a column's values fall into the round."""
    rounds = max(1, -(-amount // max(room, 1)))
    out = None
    for k in range(rounds):
        x = written(part(lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == k if rounds > 1 else F.lit(True)), tag)  # noqa: B023
        out = x if out is None else out.union(x)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, n: int) -> DataFrame:
    """Of (a, b) those whose full run sets have at least this Jaccard similarity. `pairs` is read for each round."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 500):
                p = x.slice(lo, 500)
                both, na, nb = shared_runs(p.column(2), p.column(3), n)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(pa.array(both / np.maximum(na + nb - both, 1) >= similarity))

    def part(mine: Callable[[str], Column]) -> DataFrame:
        own = pairs.where(mine("a"))
        kept = in_bits(sets, "_id", bits_of(own.select(F.explode(F.array("a", "b")).alias("_id")), "_id"))
        one = lambda x: kept.select(F.col("_id").alias(x), F.col("_w").alias(f"w{x}"))
        return own.join(one("a"), "a").join(one("b"), "b").select("a", "b", "wa", "wb").mapInArrow(check, "a bigint, b bigint")

    return _in_rounds(pairs.count(), sets.count() // 2, part, "links")


def _fit(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _may(n: Column, s: Column, m: Column, t: Column, similarity: float) -> Column:
    """Whether sets of n and m runs with these sketches can have this similarity: each bit that only one has is a run
    that the other lacks."""
    only = lambda x, y: sum((F.bit_count(x[i].bitwiseAND(F.bitwise_not(y[i]))) for i in range(SKETCH)), F.lit(0))
    both = F.least(n - only(s, t), m - only(t, s))
    return _fit(n, m, similarity) & (both * (1 + similarity) >= similarity * (n + m) - 1e-9)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    one = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    may = _may(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), similarity)
    return pairs.join(one("a"), "a").join(one("b"), "b").where(may).select("a", "b")


def _hot_pairs(hot: DataFrame, sets: DataFrame, similarity: float, words: int, rare: int = RARE) -> DataFrame:
    """(a, b) across components such that, with the links among them, members of a bucket are connected as by all pairs.

    Runs are ordered by the number of notes of hot buckets that have them. Two sets of this similarity share a run among
    the first n - ceil(similarity * n) + 1 of each. If that run is rare, the pair is found by it. Else all they share
    are frequent runs, which must then make up the similarity. Of the members of a bucket with the same frequent runs
    the smallest set is at least as similar to all others as any of them is, so all are tried against it only. Runs of
    one note only come first in that order and are not sent on: how many there are says what the others leave of it.
    """
    ids = written(hot.select("id", "n", "root").distinct(), "hot")
    own = in_bits(sets, "_id", written(bits_of(ids, "id"), "hot"))
    room, total = sets.count(), ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = _in_rounds(total, 16 * room, lambda mine: runs_of(own, words).where(mine("run")).groupBy("run").agg(F.count("*").cast("int").alias("c")).where("c > 1"), "runs")

    def ordered(mine: Callable[[str], Column]) -> DataFrame:
        runs = runs_of(own.where(mine("_id")), words).join(held, "run").groupBy(F.col("_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("c", "run"))).alias("o"))
        x = ids.where(mine("id")).join(runs, "id", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<c: int, run: bigint>>")))
        often = F.transform(F.filter("o", lambda y: y.c > rare), lambda y: y.run)
        left = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("o"))
        x = x.select("id", "n", "root", F.size(often).alias("t"), F.xxhash64(often).alias("kind"), F.slice("o", F.lit(1), F.greatest(left, F.lit(0)).cast("int")).alias("first"))
        return x.select("id", "n", "root", "t", "kind", F.transform(F.filter("first", lambda y: y.c <= rare), lambda y: y.run).alias("rare"), F.exists("first", lambda y: y.c > rare).alias("heavy"))

    order = _in_rounds(total, 16 * room, ordered, "orders")

    def met(mine: Callable[[str], Column]) -> DataFrame:
        one = order.select("id", "n", "root", F.explode("rare").alias("run")).where(mine("run"))
        l, r = one.alias("l"), one.alias("r")
        found = l.join(r, (F.col("l.run") == F.col("r.run")) & (F.col("l.root") < F.col("r.root")) & _fit(F.col("l.n"), F.col("r.n"), similarity))
        return found.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()

    found = _in_rounds(order.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()[0], 8 * room, met, "met")
    heavy = hot.select("h", "id").join(order.where("heavy").select("id", "n", "root", "t", "kind"), "id")
    least = heavy.groupBy("h", "kind").agg(F.min(F.struct("n", "id", "root", "t")).alias("y")).select("h", "y")
    enough = F.least("t", "y.t") >= similarity / (1 + similarity) * (F.col("n") + F.col("y.n")) - 1e-9
    by_kind = heavy.join(least, "h").where((F.col("root") != F.col("y.root")) & _fit(F.col("n"), F.col("y.n"), similarity) & enough)
    return found.union(by_kind.select(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")))


def near_duplicate_groups(df: DataFrame, key: str = "guid", text: str = "text", similarity: float = 0.8, n: int = 5, least_words: int = 0, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """One row per distinct key: `key`, group_id (string).

    Notes with at least `least_words` words and one run of `n` words are linked if the Jaccard similarity of their run
    sets is at least `similarity`; group_id is equal exactly for notes connected by links. Other notes (null, empty or
    short texts) are groups of their own, whose id is made of the key. Rows with a null key are left out. Repeated
    rows of a key and text count once; a key with several texts is in the group of each text that is long enough, as one row for each.
    Other columns are ignored; an empty table gives an empty result. Links are found with the probability
    `recall_at(similarity)` at the threshold, more above it; every link reported is exact.
    """
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    sets, members = classes(with_words(d, ["_key"], "_text", n, F.lit(least_words)))
    h = sets.select("_id", "_n", "_w").mapInArrow(lambda it: _bands(it, n, bands, rows), "h bigint, id bigint, n int")
    h = written(h, "bands")
    shared = h.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("_hi")).where("rep < _hi").select("h", "rep")
    met = written(h.join(shared, "h"), "buckets")
    dropped(h)
    room = sets.count()
    sketches = written(sets.select("_id", "_n", "_w").mapInArrow(lambda it: _sketches(it, n), "id bigint, n int, s array<bigint>"), "sketches")
    stars = written(met.where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    star = _in_rounds(stars.count(), 2 * room, lambda mine: _likely(stars.where(mine("a")), sketches, similarity), "star")
    dropped(stars)
    links = _verified(star, sets, similarity, n)
    part = written(connected_components(links), "parts")
    # members of a bucket that the stars left in different components
    placed = met.join(part, met.id == part.node, "left").select("h", "id", "n", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("h", "c")
    placed = written(placed.join(mixed, "h"), "mixed")
    few, far = placed.where(F.col("c") <= hot), placed.where(F.col("c") > hot)

    def across(mine: Callable[[str], Column]) -> DataFrame:
        x = few.where(mine("h")).join(sketches.select("id", "s"), "id").select("h", "id", "n", "root", "s")
        l, r = x.alias("l"), x.alias("r")
        j = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.root") < F.col("r.root")) & _may(F.col("l.n"), F.col("l.s"), F.col("r.n"), F.col("r.s"), similarity))
        return j.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()

    rest = _in_rounds(few.count(), 2 * room, across, "rest")
    if not far.isEmpty():
        more = written(_hot_pairs(far, sets, similarity, n).distinct(), "rest")
        rest = rest.union(_in_rounds(more.count(), 2 * room, lambda mine: _likely(more.where(mine("a")), sketches, similarity), "rest"))
    rest = written(rest.distinct().join(star, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, sets, similarity, n)
    # roots of the first pass are joined by the new links
    roots = more.join(part, more.a == part.node, "left").select(F.coalesce("root", "a").alias("a"), "b")
    roots = roots.join(part, roots.b == part.node, "left").select("a", F.coalesce("root", "b").alias("b"))
    top = connected_components(roots)
    up = part.join(top, part.root == top.node, "left").select(part.node, F.coalesce(top.root, part.root).alias("root"))
    new = top.join(part, top.node == part.node, "left_anti").select("node", "root")
    group = up.union(new)
    mine = members.select("_key", F.col("_id").alias("node")).join(group, "node", "left").select(F.col("_key").alias(key), F.coalesce("root", "node").cast("string").alias("group_id")).distinct()
    alone = d.select(F.col("_key").alias(key)).distinct().join(members.select(F.col("_key").alias(key)), key, "left_anti")
    return mine.union(alone.select(key, F.concat(F.lit("own "), F.col(key).cast("string")).alias("group_id")))


def group_pairs(groups: DataFrame, key: str = "guid") -> DataFrame:
    """The pairs of different keys in one group: (key_a, key_b), the smaller first."""
    groups = groups.select(key, "group_id").distinct()
    many = groups.groupBy("group_id").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_lo < _hi").select("group_id")
    g = groups.join(many, "group_id", "left_semi")
    # a pair in several groups counts in the least of them, so the pairs themselves need not be shuffled
    several = g.groupBy(key).agg(F.collect_list("group_id").alias("_g")).where(F.size("_g") > 1)
    g = g.join(several, key, "left")
    l, r = (g.select("group_id", F.col(key).alias(f"{key}_{x}"), F.col("_g").alias(f"_g{x}")) for x in "ab")
    j = l.join(r, "group_id").where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return j.where(F.expr("_ga IS NULL OR _gb IS NULL OR group_id = array_min(array_intersect(_ga, _gb))")).select(f"{key}_a", f"{key}_b")
