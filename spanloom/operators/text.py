"""Row-local text operators: spans of a pattern, redaction, context. None but split_tokens shuffles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space is blank, tab, line end, form feed and vertical tab.
SPACE = r" \t\r\n\f\x0b"
TOKEN = rf"[^{SPACE}]+"
#: Runs of letters, digits and _, or single other signs.
WORD_PUNCT = rf"\w+|[^\w{SPACE}]"
#: Rule annotators: type -> pattern.
RULES = {
    "EMAIL": r"[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "PHONE": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\+[0-9]+ [0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}",
    "ID": r"[0-9]{6}/[0-9]{2}|[A-Z][0-9]{7}|[A-Z]{2}-[0-9]{4}-[0-9]{4}",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{2,4}",
}


def pattern_spans(df: DataFrame, keep: list[str], patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Columns `keep`, entity_type, pos (from 0, per type), start, stop, entity: all matches of each pattern, in code points.

    Null texts have none. Python offsets are code points, so no offset repair and no window is needed. The patterns have
    no capturing groups. Rows are built as whole columns, one list a text.
    """
    compiled = {k: re.compile(p) for k, p in patterns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes, rows, ends, found = [], [], [], [], []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                for k, rx in compiled.items() if t else ():
                    m = rx.findall(t)
                    if m:
                        found += m
                        ends += [x.end() for x in rx.finditer(t)]
                        kinds.append(k)
                        sizes.append(len(m))
                        rows.append(i)
            n = np.array(sizes, np.int64)
            stop = np.array(ends, np.int32)
            start = stop - np.fromiter(map(len, found), np.int32, len(found))
            pos = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(np.repeat(np.array(rows, np.int64), n))
            kept = [b.column(i).take(at) for i in range(len(keep))]
            kind = pa.array(kinds, pa.string()).take(pa.array(np.repeat(np.arange(len(kinds)), n)))
            yield pa.RecordBatch.from_arrays([*kept, kind, pa.array(pos.astype(np.int32)), pa.array(start), pa.array(stop), pa.array(found, pa.string())], [*keep, "entity_type", "pos", "start", "stop", "entity"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, entity_type string, pos int, start int, stop int, entity string")


#: Tokens by name; 'char' takes every single letter, digit and _.
TOKENIZERS = {"space": TOKEN, "word_punct": WORD_PUNCT, "word": r"\w+", "char": r"\w"}


def tokenized(df: DataFrame, how: str = "word_punct", key: str = "document_id") -> DataFrame:
    """`key`, pos, start, stop, entity: the tokens by one of TOKENIZERS, or 'split' for `split_tokens`; another name
    raises ValueError."""
    if how == "split":
        return split_tokens(df, key).withColumnRenamed("token", "entity")
    if how not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {how!r}")
    return pattern_spans(df, [key], {"T": TOKENIZERS[how]}).drop("entity_type")


def split_tokens(df: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """`key`, pos, start, stop, token: the text split at every single white space sign, empty tokens included. An empty
    token starts where the token before it ends (0 if it is the first)."""
    d = df.select(key, F.split(text, f"[{SPACE}]").alias("p")).select(key, F.posexplode("p").alias("pos", "token"))
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("stop", (F.sum(F.length("token") + 1).over(w) - 1).cast("int"))
    before = F.coalesce(F.lag("stop").over(W.partitionBy(key).orderBy("pos")), F.lit(0))
    empty = F.length("token") == 0
    return d.select(key, "pos", F.when(empty, before).otherwise(F.col("stop") - F.length("token")).alias("start"), F.when(empty, before).otherwise(F.col("stop")).alias("stop"), "token")


def redact_pattern(text: Column, pattern: str, repl: str = "___") -> Column:
    """Text with every match replaced; native, for disjoint spans."""
    return F.regexp_replace(text, pattern, repl)


def redact_spans(text: Column, spans: Column, repl: str = "___") -> Column:
    """Fold over array<struct<start, stop>> from the right, in place, one `repl` for a chain of touching spans.

    The spans may overlap: later edits see the text that earlier ones left, with the offsets of the original.
    """
    s = F.sort_array(spans, asc=False)
    start = F.struct(text.alias("t"), F.lit(-1).cast("bigint").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        a, b = x["start"].cast("bigint"), x["stop"].cast("bigint")
        joined = b == acc["last"]
        head = F.substring(acc["t"], F.lit(1), a.cast("int"))
        tail = F.substring(acc["t"], F.when(joined, b + len(repl)).otherwise(b).cast("int") + 1, F.lit(2**31 - 1))
        return F.struct(F.concat(head, F.lit(repl), F.when(joined, F.substring(acc["t"], (b + len(repl) + 1).cast("int"), F.lit(2**31 - 1))).otherwise(tail)).alias("t"), a.alias("last"))

    return F.aggregate(s, start, step, lambda acc: acc["t"])


def context(text: Column, start: Column, stop: Column, k: int = 50) -> Column:
    """`k` characters on either side with the span between ** marks, line ends as blanks."""
    a = F.greatest(start - k, F.lit(0))
    parts = [F.substring(text, a + 1, start - a), F.lit("**"), F.substring(text, start + 1, stop - start), F.lit("**"), F.substring(text, stop + 1, F.lit(k))]
    return F.translate(F.concat(*parts), "\r\n", "  ")


def csv_cell(c: Column) -> Column:
    """A cell as CSV writes it: quoted where it holds a comma, quote or line end."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
