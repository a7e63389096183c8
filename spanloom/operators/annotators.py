"""Annotators by name: rules, and models of one's own that are loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.text import RULES, pattern_spans

#: A function from notes (document_id, text) to spans (document_id, start, stop, entity_type, ...).
Annotator = Callable[[DataFrame], DataFrame]
#: A function from texts to their predictions (probability, label, start, length).
Predict = Callable[[list[str]], list[list[tuple[float, str, int, int]]]]


def rule_annotator(kind: str) -> Annotator:
    return lambda notes: pattern_spans(notes, ["document_id"], {kind: RULES[kind]}).drop("pos")


def model_annotator(load: Callable[[], Predict], batch: int = 64) -> Annotator:
    """An annotator from a model. `load` is called once per task, on the executor; texts come in batches, whole.

    Spans: document_id, start, stop, entity_type, entity, prob. Null texts have none; predictions of no length, beyond
    the text or of label O are left out.
    """

    def annotate(notes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = load()
            for b in batches:
                for lo in range(0, b.num_rows, batch):
                    p = b.slice(lo, batch)
                    texts = [t or "" for t in p.column(1).to_pylist()]
                    rows = [(i, s, s + n, k, t[s : s + n], float(q)) for i, (t, ms) in enumerate(zip(texts, predict(texts))) for q, k, s, n in ms if n > 0 and 0 <= s < len(t) and k != "O"]
                    at, *cols = zip(*rows) if rows else [()] * 6
                    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(np.array(at, np.int64))), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["document_id", "start", "stop", "entity_type", "entity", "prob"])

        kt = notes.schema["document_id"].dataType.simpleString()
        return notes.select("document_id", "text").mapInArrow(run, f"document_id {kt}, start int, stop int, entity_type string, entity string, prob double")

    return annotate


ANNOTATORS: dict[str, Annotator] = {k.lower(): rule_annotator(k) for k in RULES}


def register(name: str, annotator: Annotator) -> None:
    """Add an annotator; a name that is taken raises ValueError."""
    if name in ANNOTATORS:
        raise ValueError(f"{name!r} is taken")
    ANNOTATORS[name] = annotator


def annotate(notes: DataFrame, *names: str) -> DataFrame:
    """document_id, start, stop, entity_type, entity, annotator: the spans of the named annotators, or of all of them."""
    unknown = [n for n in names if n not in ANNOTATORS]
    if unknown:
        raise ValueError(f"no annotator {unknown}")
    parts = [ANNOTATORS[n](notes).select("document_id", "start", "stop", "entity_type", "entity", F.lit(n).alias("annotator")) for n in names or sorted(ANNOTATORS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
