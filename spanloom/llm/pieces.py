"""Splitting oversized notes at natural boundaries (problem 5).

Structure-tree packing. The gaps between tokens have strengths: before a heading by its level, at a blank line, before
a list item by its indentation, at a line end, after a sentence, after a clause. A node of the tree is a stretch of
tokens, its children are the stretches between its strongest gaps: sections hold their subsections, items the items
indented below them. Nodes over the limit are descended into, others are left whole, and whole siblings are merged as
far as the limit lets them. What is left of a node that was cut is never merged with the subtree after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a maximal run without blank, tab, line end and no-break space.
TOKEN = "[^ \\t\\r\\n\\u00a0]+"
_TOKEN = re.compile("[^ \t\r\n ]+")
_HEADING = re.compile(r"(#{1,6})[ \t]|[^\s:][^:\n\r]{0,40}:[ \t\u00a0]*(?:[\r\n]|$)|[A-Z][A-Z /&-]{3,40}:")
_ITEM = re.compile(r"(?:[-*•+]|\d{1,3}[.)])[ \t\u00a0]")
#: A heading of level h has HEADING - h, one without a level HEADING - 7; an item indented by x blanks ITEM - x, down to ITEM - MOST_INDENT.
HEADING, BLANK_LINE, ITEM, LINE, SENTENCE, CLAUSE, AFTER_HEADING = 30, 20, 19, 4, 3, 2, 1
MOST_INDENT = 12


def gap_strengths(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, token stops and the strength of the gap after each token (0: no boundary; the last has 0)."""
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not at:
        z = np.zeros(0, np.int64)
        return z, z, z
    starts, stops = np.array(at, np.int64).T
    strong = np.zeros(len(at), np.int64)
    under = _HEADING.match(text, at[0][0])
    for i in range(len(at) - 1):
        a, b = at[i][1], at[i + 1][0]
        between = text[a:b].replace("\r\n", "\n").replace("\r", "\n") if b - a > 1 or text[a] in "\r\n" else ""
        lines = between.count("\n")
        if lines:
            heading = _HEADING.match(text, b)
            if heading:
                strong[i] = HEADING - (len(heading[1]) if heading[1] else 7)
            elif under:  # the line end after a heading is the last place to cut
                strong[i] = AFTER_HEADING
            elif lines > 1:
                strong[i] = BLANK_LINE
            elif _ITEM.match(text, b):
                strong[i] = ITEM - min(len(between.rpartition("\n")[2].expandtabs(4)), MOST_INDENT)
            else:
                strong[i] = LINE
            under = heading
        else:
            last = text[a - 1]
            if last in ".!?":
                strong[i] = SENTENCE
            elif last == ";":
                strong[i] = CLAUSE
    return starts, stops, strong


def pack(strong: np.ndarray, a: int, b: int, limit: int, opening: int | None = None) -> list[tuple[int, int]]:
    """Consecutive stretches of the tokens [a, b), each of at most `limit`, cut at the strongest gaps that do. A stretch
    from token 0 may have `opening` tokens."""
    most = lambda x: limit if x or opening is None else opening
    if b - a <= most(a):
        return [(a, b)]
    inner = strong[a : b - 1]
    top = int(inner.max())
    if top == 0:
        first = a + most(a)
        return [(a, first), *[(x, min(x + limit, b)) for x in range(first, b, limit)]]
    cuts = [a, *(np.flatnonzero(inner == top) + a + 1).tolist(), b]
    units: list[tuple[int, int]] = []
    whole = False  # whether the last unit is made of whole siblings
    for x, y in zip(cuts, cuts[1:]):
        if y - x > most(x):
            units += pack(strong, x, y, limit, opening)
            whole = False
        elif whole and y - units[-1][0] <= most(units[-1][0]):
            units[-1] = (units[-1][0], y)
        else:
            units.append((x, y))
            whole = True
    return units


def piece_ranges(strong: np.ndarray, length: int, step: int) -> list[tuple[int, int, int]]:
    """(start, own, stop) token ranges of the pieces: at most `length` tokens each; those before `own` are shared with
    the piece before, `length - step` of them."""
    n = len(strong)
    if n <= length:
        return [(0, 0, n)] if n else []
    shared = length - step
    units = pack(strong, 0, n, step, length)
    first = 1
    while first < len(units) and units[first - 1][1] <= shared:  # the first piece holds more than the second shares with it
        first += 1
    return [(max(0, a - shared), a, b) for a, b in [(0, units[first - 1][1]), *units[first:]]]


def unbroken_runs(strong: np.ndarray) -> np.ndarray:
    """For each token the number of consecutive tokens about it without a boundary inside."""
    if not len(strong):
        return np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([[0], np.flatnonzero(strong[:-1]) + 1, [len(strong)]]))
    return np.repeat(runs, runs)


def _pieces(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for key, text, most, length, step in zip(p["_key"], p["_text"], p["_most"], p["_length"], p["_step"]):
            starts, stops, strong = gap_strengths(text)
            runs = unbroken_runs(strong)
            for i, (a, own, b) in enumerate(piece_ranges(strong, int(length), int(step))):
                x, y = int(starts[a]), int(stops[b - 1])
                end = "end" if b == len(strong) else "boundary" if strong[b - 1] else "hard"
                rows.append((key, i, x, y, b - a, b - own, most, bool(runs[own:b].max() > length), end, text[x:y] if with_text else None))
        yield pd.DataFrame(rows, columns=["_key", "piece_no", "start", "stop", "n_tokens", "own_tokens", "limit_tokens", "unbroken", "cut", "piece"])


def clean_name(c: Column) -> Column:
    """A data_type or source name in lower case without outer blanks, with _ for -."""
    return F.lower(F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("-"), F.lit("_")))


def split_oversized(df: DataFrame, configs: DataFrame, key: str = "guid", text: str = "text", kind: str = "data_type", with_text: bool = True) -> DataFrame:
    """One row per piece of an oversized note: `key`, piece_no (from 0), start, stop (code points of the note), n_tokens,
    own_tokens (not shared with the piece before), limit_tokens (the max_seq_length), unbroken (an own token lies in a
    run of more than sequence_length tokens without a boundary inside), cut (how the piece ends: boundary, hard or end),
    piece (its text, null if not `with_text`).

    A note is oversized if it has more tokens than the max_seq_length of its data_type in `configs` (max_seq_length,
    sequence_length, step_size per data_type; several rows of one data_type count as their least values). Pieces have
    at most sequence_length tokens, neighbours share exactly sequence_length - step_size, and together they cover the
    note. Notes of an unknown or null data_type, null or empty texts and null keys have no rows. Repeated rows count
    once. Other columns are ignored. A config with a null or non-positive length, or step_size over sequence_length,
    is left out.
    """
    c = configs.select(clean_name(F.col("data_type")).alias("_kind"), "max_seq_length", "sequence_length", "step_size")
    c = c.groupBy("_kind").agg(F.min("max_seq_length").alias("_most"), F.min("sequence_length").alias("_length"), F.min("step_size").alias("_step"))
    c = c.where("_length > 0 AND _step > 0 AND _step <= _length AND _most IS NOT NULL")
    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), clean_name(F.col(kind)).alias("_kind"))
    d = d.join(c, "_kind").where(F.size(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))) > F.col("_most"))
    schema = f"_key {df.schema[key].dataType.simpleString()}, piece_no int, start int, stop int, n_tokens int, own_tokens int, limit_tokens int, unbroken boolean, cut string, piece string"
    out = d.select("_key", "_text", "_most", "_length", "_step").mapInPandas(lambda it: _pieces(it, with_text), schema)
    return out.dropDuplicates(["_key", "piece_no", "start", "stop"]).withColumnRenamed("_key", key)


def oversized_kinds(pieces: DataFrame, key: str = "guid") -> DataFrame:
    """(key, kind) of the notes in `split_oversized`, from all their pieces: oversized where the pieces' own tokens are
    more than the limit, and unbroken where a piece is."""
    n = pieces.groupBy(key).agg(F.sum("own_tokens").alias("n"), F.min("limit_tokens").alias("most"), F.bool_or("unbroken").alias("u")).where("n > most")
    return n.select(key, F.explode(F.when(F.col("u"), F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))).alias("kind"))
