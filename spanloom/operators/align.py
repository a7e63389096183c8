"""Character labels, tokens cut where their label changes, and the labels of tokens.

Characters are rows only where a span covers them: a span of a million characters is a million rows of two numbers,
spread over tasks by document and character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.spans import BLOCK, in_blocks
from spanloom.operators.text import WORD_PUNCT


def char_labels(spans: DataFrame, label: str = "entity_type", keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """`keys`, i, label: the label of each covered character; of overlapping spans the last in order of start, stop and
    label writes it. Repeated spans change nothing; spans without characters have no rows."""
    s = spans.select(*keys, "start", "stop", F.col(label).alias("label")).where("stop > start").distinct()
    c = s.select(*keys, "start", "stop", "label", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"))
    return c.groupBy(*keys, "i").agg(F.max(F.struct("start", "stop", "label")).alias("x")).select(*keys, "i", F.col("x.label").alias("label"))


def token_chars(tokens: DataFrame, chars: DataFrame, keys: tuple[str, ...] = ("document_id",), block: int = 64) -> DataFrame:
    """Each token that has a labelled character, with those characters: columns of `tokens`, and `i` and the columns of
    `chars`. Tokens and characters meet in blocks of the text, so the join has equal keys and no cross product."""
    t = tokens.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    c = chars.withColumn("_b", F.floor(F.col("i") / block))
    return t.join(c, [*keys, "_b"]).where("i >= start AND i < stop").drop("_b")


def token_parts(tokens: DataFrame, chars: DataFrame, rank: Column, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Tokens with labelled characters, cut before each character whose label ranks higher than that of the character
    before it: `keys`, start, stop, token_start. `rank` is a string; characters without label rank lowest, as ''. A fall
    in rank does not cut; a token without labelled characters stays out.
    """
    c = token_chars(tokens, chars.withColumn("_r", rank), keys).select(*keys, "start", "stop", "i", "_r")
    w = W.partitionBy(*keys, "start", "stop").orderBy("i")
    before = F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("_r").over(w)).otherwise("")
    cut = c.withColumn("_cut", F.col("_r") > before).where("_cut AND i > start").groupBy(*keys, "start", "stop").agg(F.sort_array(F.collect_list("i")).alias("cuts"))
    t = c.select(*keys, "start", "stop").distinct().join(cut, [*keys, "start", "stop"], "left")
    edges = F.concat(F.array("start"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("stop"))
    parts = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda k: F.struct(F.get("e", k).alias("start"), F.get("e", k + 1).alias("stop")))
    return t.select(*keys, F.col("start").alias("token_start"), edges.alias("e")).select(*keys, "token_start", F.inline(parts)).select(*keys, "start", "stop", "token_start")


def modal_labels(parts: DataFrame, chars: DataFrame, keys: tuple[str, ...] = ("document_id",), ignore_none: bool = True) -> DataFrame:
    """`keys`, start, stop, label: the most frequent label of each part's characters, the least on ties. Characters
    without label are ignored, or count as a label of their own, less than all others, where `ignore_none` is false."""
    g = token_chars(parts.select(*keys, "start", "stop"), chars, keys).groupBy(*keys, "start", "stop", "label").agg(F.count("*").alias("n"))
    best = g.groupBy(*keys, "start", "stop").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.max("n").alias("n"), F.sum("n").alias("_all"))
    if not ignore_none:
        best = best.where(F.col("n") > F.col("stop") - F.col("start") - F.col("_all"))
    return best.select(*keys, "start", "stop", "label")


def aligned_tokens(tokens: DataFrame, true: DataFrame, pred: DataFrame, rank: Column, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """`keys`, start, stop, truth, pred of each part of a token: tokens are cut where the true label's rank rises; the
    true label is the part's modal one with characters without label counted, the predicted one is that of any labelled
    character. Parts without a label on either side are left out; a missing label is null. `chars` as in `char_labels`.
    """
    own = token_parts(tokens, true, rank, keys)
    cut = own.select(*keys, "token_start").distinct().withColumnRenamed("token_start", "start")
    rest = tokens.select(*keys, "start", "stop").join(cut, [*keys, "start"], "left_anti")
    parts = own.select(*keys, "start", "stop").unionByName(rest)
    t = modal_labels(parts, true, keys, ignore_none=False).withColumnRenamed("label", "truth")
    p = modal_labels(parts, pred, keys).withColumnRenamed("label", "pred")
    return t.join(p, [*keys, "start", "stop"], "full").select(*keys, "start", "stop", "truth", "pred")


def _stretches(start: list[int], stop: list[int]) -> Iterator[tuple[int, int, int]]:
    """(from, to, place): what each span has of the text; of overlapping spans the last has it. Spans are sorted by their
    starts, which all differ. Each span is opened and closed once, however deep they nest."""
    held: list[int] = []
    at = start[0] if start else 0
    for k, s in enumerate([*start, math.inf]):
        while held and at < s:
            e = min(stop[held[-1]], s)
            if e > at:
                yield at, e, held[-1]
                at = e
            else:
                held.pop()
        at = s
        held.append(k)


def _painted(base: np.ndarray, sizes: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The code of each character of texts laid end to end, 0 outside spans. Spans are sorted by text and start."""
    out = np.zeros(int(sizes.sum()), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
    for lo, hi in zip(cuts, cuts[1:]) if len(row) else ():
        o, n = int(base[row[lo]]), int(sizes[row[lo]])
        for a, b, k in _stretches(start[lo:hi].tolist(), stop[lo:hi].tolist()):
            out[o + min(max(a, 0), n) : o + min(max(b, 0), n)] = code[lo + k]
    return out


def _modes(start: np.ndarray, stop: np.ndarray, codes: np.ndarray, with_none: bool) -> np.ndarray:
    """The most frequent code of each part's characters, the least on ties; 0, no label, counts only if `with_none`."""
    out = np.zeros(len(start), np.int64)
    at = np.flatnonzero(codes)
    if not len(start) or not len(at):
        return out
    k = np.searchsorted(start, at, side="right") - 1
    inside = (k >= 0) & (at < stop[k])
    width = int(codes.max()) + 1
    key, n = np.unique(k[inside] * width + codes[at[inside]], return_counts=True)
    part, code = key // width, key % width
    if with_none:
        free = stop - start - np.bincount(part, n, len(start)).astype(np.int64)
        some = np.flatnonzero(free)
        part, code, n = np.concatenate([part, some]), np.concatenate([code, np.zeros(len(some), np.int64)]), np.concatenate([n, free[some]])
    order = np.lexsort((code, -n, part))
    part, code = part[order], code[order]
    first = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
    out[part[first]] = code[first]
    return out


def _spans_of(c: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each span, and the spans, of a column of lists of spans."""
    return np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy())), c.flatten()


#: Characters of notes that are laid end to end at once; a longer note is taken alone.
CHARS = 1_000_000


def labelled_tokens(notes: DataFrame, gold: DataFrame, pred: DataFrame | None = None, models: DataFrame | None = None, all_parts: bool = False, pattern: str = WORD_PUNCT) -> DataFrame:
    """document_id, token_start, start, stop, truth, pred, token (its text) of the tokens of notes with gold, cut where
    the true label rises: the labels as in `aligned_tokens`. Parts without a label on either side are left out; with
    `all_parts` those of tokens that have a true label somewhere stay, and only they.

    With `models`, one row with an array `ms` of model names, `pred` has a model_name and each part comes once per model,
    with model_name first. A true label that is null or empty is none; a predicted null comes last on ties.

    Only notes and spans are shuffled, no tokens and no characters. Of spans with one start only the longest can be
    seen, so a note comes with at most as many spans of a model as it has characters.
    """
    more = ["model_name"] if models is not None else []

    def side(spans: DataFrame, name: str, *by: str) -> DataFrame:
        s = spans.where("stop > start").groupBy("document_id", *by, "start").agg(F.max(F.struct("stop", F.col("entity_type").alias("label"))).alias("x"))
        return s.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*by, "start", F.col("x.stop").alias("stop"), F.col("x.label").alias("label")))).alias(name))

    d = notes.where("text IS NOT NULL").join(side(gold, "g"), "document_id")
    if pred is not None:
        own = pred.join(gold.select("document_id").distinct(), "document_id", "left_semi")
        own = own.where(F.col("model_name").isNotNull()) if more else own
        d = d.join(side(own, "q", *more), "document_id", "left")
    else:
        d = d.withColumn("q", F.lit(None).cast("array<struct<start: int, stop: int, label: string>>"))
    d = d.crossJoin(F.broadcast(models)) if more else d
    rx = re.compile(pattern)

    def aligned(p: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = p.column(1).to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(sizes) - sizes
        at = [[m.span() for m in rx.finditer(t)] for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in at])
        spans = np.array([y for x in at for y in x], np.int64).reshape(-1, 2) + base[row][:, None]
        token, token_stop = spans[:, 0], spans[:, 1]
        (gr, g), (qr, q) = _spans_of(p.column(2)), _spans_of(p.column(3))
        g_names, q_names = g.field("label").to_pylist(), q.field("label").to_pylist()
        names = sorted({"", *g_names, *q_names} - {None})
        code = {x: i for i, x in enumerate(names)} | {None: 0}
        ends = lambda x: (x.field("start").to_numpy().astype(np.int64), x.field("stop").to_numpy().astype(np.int64))
        truth = _painted(base, sizes, gr, *ends(g), np.array([code[x] for x in g_names], np.int64))
        code = {x: i + 1 for i, x in enumerate(names)} | {None: len(names) + 1}
        q_code = np.array([code[x] for x in q_names], np.int64)
        cut = np.flatnonzero(truth[1:] > truth[:-1]) + 1
        if len(token):
            k = np.searchsorted(token, cut, side="right") - 1
            cut = cut[(k >= 0) & (cut > token[k]) & (cut < token_stop[k])]
        else:
            cut = cut[:0]
        start = np.sort(np.concatenate([token, cut]))
        of = np.searchsorted(token, start, side="right") - 1
        stop = np.minimum(token_stop[of], np.append(start[1:], len(truth)))
        t = _modes(start, stop, truth, True)
        if all_parts:
            seen = np.zeros(len(token) + 1, bool)
            x = np.flatnonzero(truth)
            k = np.searchsorted(token, x, side="right") - 1
            seen[k[(k >= 0) & (x < np.append(token_stop, 0)[k])]] = True
        qs = ends(q)
        of_model = np.array(q.field("model_name").to_pylist(), object) if more else None
        for m in p.column(4)[0].as_py() if more else (None,):
            mine = of_model == m if more else slice(None)
            z = _modes(start, stop, _painted(base, sizes, qr[mine], *[x[mine] for x in qs], q_code[mine]), False)
            z_label = pa.array([None, *names, None], pa.string()).take(pa.array(z))
            keep = np.flatnonzero(seen[of] if all_parts else (t > 0) | ((z > 0) & (z <= len(names))))
            r, of_keep = row[of[keep]], token[of[keep]]
            o = base[r]
            a, b = start[keep] - o, stop[keep] - o
            words = [texts[i][x:y] for i, x, y in zip(r.tolist(), a.tolist(), b.tolist())]
            cols = [p.column(0).take(pa.array(r)), *[pa.array(x, pa.int32()) for x in (of_keep - o, a, b)]]
            cols += [pa.array([None, *names[1:]], pa.string()).take(pa.array(t[keep])), z_label.take(pa.array(keep)), pa.array(words, pa.string())]
            cols = [pa.array([m] * len(keep), pa.string()), *cols] if more else cols
            yield pa.RecordBatch.from_arrays(cols, [*more, "document_id", "token_start", "start", "stop", "truth", "pred", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.cumsum(pc.utf8_length(b.column(1)).to_numpy().astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + CHARS, side="right")))
                yield from aligned(b.slice(lo, hi - lo))
                lo = hi

    empty = F.array().cast(d.schema["q"].dataType)
    kt = notes.schema["document_id"].dataType.simpleString()
    out = f"document_id {kt}, token_start int, start int, stop int, truth string, pred string, token string"
    return d.select("document_id", "text", "g", F.coalesce("q", empty).alias("q"), *["ms"] * bool(more)).mapInArrow(run, "model_name string, " * bool(more) + out)


def lower_bound_tokens(spans: DataFrame, tokens: DataFrame, key: str = "document_id") -> DataFrame:
    """Tokens of each span by where they start: those that start in [start, stop); a span that no token starts in or
    after has the document's last token. `key`, entity_type, span_start, span_stop, start, stop."""
    s = spans.select(key, "entity_type", F.col("start").alias("span_start"), F.col("stop").alias("span_stop")).distinct()
    t = tokens.select(key, "start", "stop")
    b = in_blocks(s, start="span_start", stop="span_stop").join(t.withColumn("_b", F.floor(F.col("start") / BLOCK)), [key, "_b"])
    inside = b.where("start >= span_start AND start < span_stop").drop("_b")
    last = t.groupBy(key).agg(F.max(F.struct("start", "stop")).alias("x")).select(key, "x.start", "x.stop")
    after = s.join(last, key).where("start < span_start")
    return inside.unionByName(after.select(*inside.columns))


def context_of_tokens(spans: DataFrame, tokens: DataFrame, k: int = 3, key: str = "document_id") -> DataFrame:
    """`key`, start, stop, before, after: the k tokens on either side of each span, as text joined by blanks. Tokens
    that overlap the span belong to neither side. `tokens`: pos, start, stop, entity. Documents without tokens have no
    rows. Tokens and spans go through one ordered window each way, so the work is linear in a document's length.
    """
    s = spans.select(key, F.col("start").alias("s"), F.col("stop").alias("e")).distinct().join(tokens.select(key).distinct(), key, "left_semi")
    w = W.partitionBy(key).orderBy("pos")
    words = lambda at: F.concat_ws(" ", *[at(i) for i in range(k - 1, -1, -1)])
    t = tokens.select(key, "start", "stop", words(lambda i: F.lag("entity", i).over(w)).alias("back"), F.concat_ws(" ", *[F.lead("entity", i).over(w) for i in range(k)]).alias("on"))
    none = F.lit(None).cast("string")

    def nearest(at_token: str, at_span: str, text: str, sign: int, name: str) -> DataFrame:
        row = lambda x, kind, *more: x.select(key, (sign * F.col(at_token if kind == 0 else at_span)).alias("_o"), F.lit(kind).alias("_k"), *more)
        none_ = F.lit(None).cast("int")
        u = row(t, 0, none_.alias("s"), none_.alias("e"), F.col(text).alias("x")).unionByName(row(s, 1, F.col("s"), F.col("e"), none.alias("x")))
        last = F.last("x", ignorenulls=True).over(W.partitionBy(key).orderBy("_o", "_k").rowsBetween(W.unboundedPreceding, 0))
        return u.withColumn(name, F.coalesce(last, F.lit(""))).where("_k = 1").select(key, "s", "e", name)

    j = nearest("stop", "s", "back", 1, "before").join(nearest("start", "e", "on", -1, "after"), [key, "s", "e"])
    return j.select(key, F.col("s").alias("start"), F.col("e").alias("stop"), "before", "after")


def subwords(words: DataFrame, width: int = 4, key: str = "document_id") -> DataFrame:
    """Words cut into pieces of `width` characters, numbered through the document: `key`, word (its place), piece, start,
    stop, is_sub (same word as the piece before), word_start, word_length (characters from this piece to the word's end).
    A stand-in for a trained sub-word vocabulary with the same columns; row-local but for nothing, so no shuffle."""
    n = F.ceil((F.col("stop") - F.col("start")) / width).cast("int")
    w = words.select(key, F.col("pos").alias("word"), F.col("start").alias("word_start"), F.col("stop").alias("_e"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    w = w.withColumn("start", F.col("word_start") + F.col("piece") * width)
    return w.select(key, "word", "piece", "start", F.least(F.col("start") + width, F.col("_e")).alias("stop"), (F.col("piece") > 0).alias("is_sub"), "word_start", (F.col("_e") - F.col("start")).alias("word_length"))


def window_starts(n: Column, length: Column, step: Column) -> Column:
    """Starts of windows of `length` tokens over n tokens, `step` apart; the last one reaches the end."""
    last = F.greatest(F.ceil((n - length) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: (i * step).cast("int"))
