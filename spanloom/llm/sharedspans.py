"""Long exact spans shared between documents (problem 8).

Prefix-partitioned suffix trees over a synchronised set of suffixes. In every window of WINDOW neighbouring PREFIX-grams
the one of least hash is an anchor. Two equal stretches of WINDOW + PREFIX - 1 = 200 characters choose the same anchor,
so every shared stretch of that length holds an anchor with PREFIX shared characters from there on, in both documents.
Suffixes are therefore taken at anchors only, and those whose prefix occurs in one document alone are dropped. The rest
are partitioned by their prefix; a task sorts the suffixes of its prefixes, which with the lengths of the common
prefixes of neighbours is their suffix tree, and walks its nodes of depth PREFIX to 200: the leaves under a node of
depth 200 - t that also agree on the t characters to the left share a stretch of 200.

Prefixes have variable length. A group of more suffixes than fit in memory is cut by longer prefixes, again and again.
A group whose suffixes agree from `l` characters left of the anchor to `r` right of it holds the stretches that start
t = l to 200 - r characters before the anchor. Those of the nearer half of these t agree on more characters to the
right, those of the farther half on more to the left, so each suffix goes on with one longer prefix for either half.
Where l + r reaches 200 the prefix is the stretch itself: all suffixes of the group share it, and it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.hashing import BASE, BATCH_CHARS, codes_of, mixed, prefix_sums, range_hashes
from spanloom.session import dropped, written

#: Characters from an anchor on by which suffixes are partitioned first, as a share of the least length.
PREFIX_SHARE = 0.5
#: Most suffixes of one prefix that a task takes into a tree; larger groups get longer prefixes.
TREE_SUFFIXES = 20_000


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window the position of its least hash (by its upper half; the leftmost on ties)."""
    m = len(h) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    half = np.uint64(32)
    x = np.full(len(h) + (-len(h) % window), np.uint64(2**64 - 1))
    x[: len(h)] = (h >> half << half) | np.arange(len(h), dtype=np.uint64)
    x = x.reshape(-1, window)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:m], left[window - 1 : window - 1 + m]) & np.uint64(2**32 - 1)).astype(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], prefix: int, window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and chars + len(texts[hi]) <= BATCH_CHARS:
                chars += len(texts[hi])
                hi += 1
            sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
            ends = np.cumsum(sizes)
            s = prefix_sums(codes_of("".join(texts[lo:hi])))
            first = np.arange(max(0, len(s) - prefix))
            h = range_hashes(s, first, first + prefix)
            at = anchors(h, window)
            doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
            inside = np.flatnonzero(np.arange(len(at)) + window + prefix - 1 <= ends[doc])
            at, doc = at[inside], doc[inside]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            at, doc = at[new], doc[new]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((at - (ends - sizes)[doc]).astype(np.int32))], ["h", "_id", "pos"])
            lo = hi


def _per_document(b: pa.RecordBatch) -> Iterator[tuple[int, str, dict[str, np.ndarray]]]:
    """Of rows (_id, _text, at): the document and its anchors' fields. Anchors beyond the text (of another text of the
    same key) are left out."""
    at = b.column(2)
    ends = at.offsets.to_numpy()
    ends = ends - ends[0]
    x = at.flatten()
    fields = {x.type.field(i).name: x.field(i).to_numpy() for i in range(x.type.num_fields)}
    for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
        own = {k: v[ends[i] : ends[i + 1]] for k, v in fields.items()}
        ok = own["pos"] < len(text)
        yield key, text, own if ok.all() else {k: v[ok] for k, v in own.items()}


def _contexts(batches: Iterator[pa.RecordBatch], left: int, right: int) -> Iterator[pa.RecordBatch]:
    """The characters around each anchor (code point + 1, 0 outside the text), one byte each where all fit, else four."""
    around = np.arange(left + right)
    for b in batches:
        cols: dict[str, list] = {k: [] for k in ("h", "_id", "pos", "l", "r")}
        raw, sizes = [], []
        for key, text, at in _per_document(b):
            if not len(at["pos"]):
                continue
            c = codes_of(text)
            padded = np.zeros(len(c) + left + right, np.uint32)
            padded[left : left + len(c)] = c + 1
            x = padded[at["pos"].astype(np.int64)[:, None] + around]
            wide = x.max(axis=1) > 255
            if wide.any():
                raw += [r.tobytes() if w else r.astype(np.uint8).tobytes() for r, w in zip(x, wide)]
            else:
                raw.append(x.astype(np.uint8).tobytes())
            sizes.append(np.where(wide, 4, 1) * (left + right))
            cols["_id"].append(np.full(len(x), key, np.int64))
            for k in ("h", "pos", "l", "r"):
                cols[k].append(at[k])
        if sizes:
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            ctx = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(raw))])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(v)) for v in cols.values()], ctx], [*cols, "ctx"])


def _decoded(ctx: pa.Array, width: int) -> np.ndarray:
    out = np.empty((len(ctx), width), np.uint32)
    ends = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1]
    data = np.frombuffer(ctx.buffers()[2] or b"", np.uint8)
    wide = np.diff(ends) > width
    if not wide.any() and len(ctx):
        return data[ends[0] : ends[-1]].reshape(-1, width).astype(np.uint32)
    for i in range(len(ctx)):
        v = data[ends[i] : ends[i + 1]]
        out[i] = v.view(np.uint32) if wide[i] else v
    return out


def _several(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the rows of equal `group` have more than one id, for each row."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    no = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(g)) - 1
    out = np.empty(len(g), bool)
    out[order] = (i[first] != i[last])[no]
    return out


def tree_spans(h: np.ndarray, ids: np.ndarray, pos: np.ndarray, l: np.ndarray, r: np.ndarray, ctx: np.ndarray, left: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, stop) of the stretches of `least` characters around anchors that another id has too, merged per anchor.

    `ctx`: (n, left + least) code points + 1, 0 outside the text; column `left` is the anchor. A suffix looks for the
    stretches that start l to least - r characters before its anchor.
    """
    right = ctx[:, left:]
    text = np.ascontiguousarray(right.astype(np.uint8)).view(f"S{least}") if len(right) and right.max() < 256 else np.ascontiguousarray(right).byteswap().view(f"S{4 * least}")
    order = np.lexsort((text.ravel(), h))
    h, ids, pos, l, r, ctx = h[order], ids[order], pos[order], l[order], r[order], ctx[order]
    right = ctx[:, left:]
    same = (right[1:] == right[:-1]) & (right[1:] != 0)
    lcp = np.where(same.all(axis=1), least, np.argmin(same, axis=1)) if len(same) else np.zeros(0, np.int64)
    lcp = np.where(h[1:] == h[:-1], lcp, 0)
    # hash of the t characters before the anchor, growing with t
    lo, hi = np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
    outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lh = np.zeros(len(h), np.uint64)
    inside = np.ones(len(h), bool)
    for t in range(0, left + 1):
        if t:
            c = ctx[:, left - t]
            with np.errstate(over="ignore"):
                lh = (lh + c.astype(np.uint64)) * BASE
            lh = mixed(lh)
            inside &= c != 0
        node = np.concatenate([[0], np.cumsum(lcp < least - t)]).astype(np.uint64)
        take = np.flatnonzero(inside & (ctx[:, left + least - t - 1] != 0) & (t >= l) & (t <= least - r))
        if not len(take):
            continue
        with np.errstate(over="ignore"):
            key = lh[take] ^ mixed(node[take] + np.uint64(12345))
        hit = take[_several(key, ids[take])]
        if not len(hit):
            continue
        a = pos[hit] - t
        joins = (lo[hit] >= 0) & (a + least >= lo[hit])
        rest = hit[(~joins) & (lo[hit] >= 0)]
        if len(rest):
            outs.append((ids[rest], lo[rest].copy(), hi[rest].copy()))
        hi[hit] = np.where(joins, hi[hit], a + least)
        lo[hit] = a
    kept = np.flatnonzero(lo >= 0)
    outs.append((ids[kept], lo[kept], hi[kept]))
    return tuple(np.concatenate(x) for x in zip(*outs))


def _trees(batches: Iterator[pa.RecordBatch], left: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches arrive sorted by prefix within the partition; a prefix cut by a batch's end waits for its other rows."""
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = [np.concatenate([p.column(i).to_numpy() for p in parts]).astype(np.int64) for i in range(5)]
        x = tree_spans(*cols, np.concatenate([_decoded(p.column(5), left + least) for p in parts]), left, least)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in x], ["_id", "a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        other = np.flatnonzero(h != h[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield done([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        if len(other) == 0 and len(held) > 1 and held[0].column(0)[0].as_py() != held[-1].column(0)[0].as_py():
            yield done(held[:-1])
            held = held[-1:]
    if held:
        yield done(held)


def _longer(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The two longer prefixes of each anchor in an oversized group, each for half of its stretches."""
    for b in batches:
        for key, text, at in _per_document(b):
            c = codes_of(text)
            sums = prefix_sums(c), prefix_sums(c + np.uint32(0x200000))
            pos, l, r = (at[k].astype(np.int64) for k in ("pos", "l", "r"))
            mid = (l + least - r) // 2
            p = np.concatenate([pos, pos])
            ll, rr = np.concatenate([l, mid + 1]), np.concatenate([least - mid, r])
            ok = (p - ll >= 0) & (p + rr <= len(c))
            p, ll, rr = p[ok], ll[ok], rr[ok]
            with np.errstate(over="ignore"):
                h, h2 = (mixed(range_hashes(s, p - ll, p + rr) + np.uint64(31) * ll.astype(np.uint64)).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), pa.array(np.full(len(p), key, np.int64)), pa.array(p.astype(np.int32)), pa.array(ll.astype(np.int32)), pa.array(rr.astype(np.int32))], ["h", "h2", "_id", "pos", "l", "r"])


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, tree_suffixes: int = TREE_SUFFIXES) -> DataFrame:
    """(`key`, start, stop): the maximal stretches in which every character lies in a run of at least `least` characters
    that occurs verbatim in the text of another key.

    Offsets are code points, half-open. Texts are compared as they are, whole, with case and white space. A text that
    several keys have is shared from end to end. Null keys, null texts and texts under `least` characters have no rows;
    repeated rows of a key count once; a key with several texts gets the stretches of each. Other columns are ignored;
    an empty table gives an empty result. The key is a bigint.
    """
    prefix = max(1, int(least * PREFIX_SHARE))
    window = least - prefix + 1
    left = least - prefix
    d = df.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    # of a text that several keys have, by 128 bits of it, one goes into the search; all of them are shared from end to end
    bits = [F.xxhash64("_text").alias("t1"), F.xxhash64(F.lit(17), "_text").alias("t2")]
    t = d.select("_id", F.length("_text").cast("bigint").alias("b"), *bits)
    copies = t.groupBy("t1", "t2").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("t1", "t2", "lo")
    copied = written(t.join(copies, ["t1", "t2"]).select("_id", "b", "t1", "t2", "lo"), "copies")
    d = d.select("*", *bits).join(copied.where("_id <> lo").select("_id", "t1", "t2"), ["_id", "t1", "t2"], "left_anti").select("_id", "_text")
    rows = written(d.mapInArrow(lambda it: _anchor_rows(it, prefix, window), "h bigint, _id bigint, pos int"), "anchors")
    counts = lambda x, *by: x.groupBy(*by).agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count("*").alias("c")).where("lo < hi").drop("lo", "hi")
    shared = written(counts(rows, "h"), "shared")
    big = not shared.where(F.col("c") > tree_suffixes).isEmpty()
    ctx = "h bigint, _id bigint, pos int, l int, r int, ctx binary"

    def with_text(at: DataFrame) -> DataFrame:
        """Documents with their anchors, of which a document has as many as windows, at most."""
        return d.join(at.groupBy("_id").agg(F.collect_set(F.struct("h", "pos", "l", "r")).alias("at")), "_id").select("_id", "_text", "at")

    def spans(at: DataFrame) -> DataFrame:
        c = with_text(at).mapInArrow(lambda it: _contexts(it, left, least), ctx)
        return c.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _trees(it, left, least), "_id bigint, a bigint, b bigint")

    at = rows.join(shared, "h").select("h", "_id", "pos", F.lit(0).alias("l"), F.lit(prefix).alias("r"), "c")
    found = spans(at.where(F.col("c") <= tree_suffixes))
    while big:
        more = with_text(at.where(F.col("c") > tree_suffixes)).mapInArrow(lambda it: _longer(it, least), "h bigint, h2 bigint, _id bigint, pos int, l int, r int")
        more = written(more, "longer")
        at = written(more.join(counts(more, "h", "h2"), ["h", "h2"]).drop("h2"), "longer")
        dropped(more)
        whole = F.col("l") + F.col("r") == least
        found = found.unionByName(at.where(whole).select("_id", (F.col("pos") - F.col("l")).cast("bigint").alias("a"), (F.col("pos") + F.col("r")).cast("bigint").alias("b")))
        at = at.where(~whole)
        found = found.unionByName(spans(at.where(F.col("c") <= tree_suffixes)))
        big = not at.where(F.col("c") > tree_suffixes).isEmpty()
    found = found.unionByName(copied.select("_id", F.lit(0).cast("bigint").alias("a"), "b"))
    w = W.partitionBy("_id").orderBy("a", "b")
    m = found.groupBy("_id", "a").agg(F.max("b").alias("b"))
    m = m.withColumn("p", F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)))
    m = m.withColumn("i", F.sum(F.when(F.col("p").isNull() | (F.col("a") > F.col("p")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return m.groupBy("_id", "i").agg(F.min("a").cast("int").alias("start"), F.max("b").cast("int").alias("stop")).select(F.col("_id").cast(df.schema[key].dataType).alias(key), "start", "stop")


def shared_report(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct key: `key`, n_chars, n_spans, shared_chars, shared_part (0 for texts that share nothing or are empty)."""
    s = spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("shared_chars"))
    d = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("n_chars"))
    j = d.join(s, key, "left").na.fill({"n_spans": 0, "shared_chars": 0})
    return j.select(key, "n_chars", "n_spans", "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("shared_part"))
