"""From scores of sub-words to stand-off predictions, and other operators on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import labels as L
from spanloom.operators.periods import merged_periods


def standoff(scored: DataFrame, names: list[str], ignore: str = "O", key: str = "document_id") -> DataFrame:
    """`key`, start, length, label, prob from scores of sub-words in overlapping windows.

    `scored`: `key`, segment, start, stop, word_length, is_sub, special, logits. Special tokens and the label `ignore`
    make no prediction; of several windows that score a sub-word the last one holds, also where it says `ignore`. A
    word's first sub-word stands for the rest of its word, a further one for itself. Null logits make no prediction.
    """
    best = scored.where("NOT special AND logits IS NOT NULL").groupBy(key, "start").agg(F.max_by(F.struct("stop", "word_length", "is_sub", "logits"), "segment").alias("x"))
    p = best.select(key, "start", "x.*").withColumn("k", L.first_argmax(F.col("logits")))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") + 1).cast("int"))
    p = p.select(key, "start", F.when(F.col("is_sub"), F.col("stop") - F.col("start")).otherwise(F.col("word_length")).alias("length"), label.alias("label"), F.array_max(L.softmax(F.col("logits"))).alias("prob"))
    return p.where(F.col("label") != ignore)


def combined(model: DataFrame, rules: DataFrame, features: dict[str, str] = L.FEATURE_LABELS, key: str = "document_id") -> DataFrame:
    """`key`, feature, label, start, stop: per rule feature the union of the rule's spans and the model's spans of the
    label that the feature stands for, merged where they overlap or touch; model spans of other labels stay as they are,
    with a null feature. Features of one label each repeat the model's spans of it.

    `model`: `key`, label, start, stop; `rules`: `key`, feature, start, stop.
    """
    of = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(x).alias("label")) for f, x in features.items()])
    mine = model.select(key, "start", "stop", "label", F.explode(F.filter(of, lambda x: x["label"] == F.col("label"))).alias("x")).select(key, F.col("x.feature").alias("feature"), "start", "stop")
    both = mine.unionByName(rules.where(F.col("feature").isin(*features)).select(key, "feature", "start", "stop"))
    label = F.create_map(*[F.lit(v) for kv in features.items() for v in kv])[F.col("feature")]
    done = merged_periods(both, [key, "feature"]).select(key, "feature", label.alias("label"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    rest = model.where(~F.col("label").isin(*features.values())).select(key, F.lit(None).cast("string").alias("feature"), "label", "start", "stop")
    return done.unionByName(rest.distinct())


def review(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    """`key`, start, stop, type_a, type_b, verdict ('same', 'type', 'a', 'b'): two annotators' spans side by side."""
    j = a.select(key, "start", "stop", F.col("entity_type").alias("type_a")).distinct().join(b.select(key, "start", "stop", F.col("entity_type").alias("type_b")).distinct(), [key, "start", "stop"], "full")
    verdict = F.when(F.col("type_b").isNull(), "a").when(F.col("type_a").isNull(), "b").when(F.col("type_a") == F.col("type_b"), "same").otherwise("type")
    return j.withColumn("verdict", verdict)


def running_by_score(counts: DataFrame, score: str, cols: list[str], buckets: int = 256) -> DataFrame:
    """`score`, `cols` summed over all rows of at least this score, and `all_`+col over all rows.

    Two levels, so that no task holds all scores: totals of `buckets` ranges cut at quantiles, then sums within a range.
    `counts` has one row per distinct score. An empty table gives no rows.
    """
    q = counts.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 10000).alias("_q"))  # one row
    c = counts.crossJoin(F.broadcast(q)).withColumn("_b", F.size(F.filter("_q", lambda x: x <= F.col(score)))).drop("_q")
    total = c.groupBy("_b").agg(*[F.sum(x).alias(f"_t_{x}") for x in cols])  # at most `buckets` rows
    down = W.orderBy(F.desc("_b"))
    total = total.select("_b", *[(F.sum(f"_t_{x}").over(down) - F.col(f"_t_{x}")).alias(f"_p_{x}") for x in cols], *[F.sum(f"_t_{x}").over(W.partitionBy()).alias(f"all_{x}") for x in cols])
    w = W.partitionBy("_b").orderBy(F.desc(score))
    j = c.join(F.broadcast(total), "_b")
    return j.select(score, *[(F.sum(x).over(w) + F.col(f"_p_{x}")).alias(x) for x in cols], *[f"all_{x}" for x in cols])


def noise_ranking(probs: DataFrame, key: str, label: str, p: str, least: int = 5) -> DataFrame:
    """`key`, label, suggested, margin of rows whose label is doubtful by confident learning, the least margin first to
    be looked at.

    A class's threshold is the mean of p[class] over the rows labelled so. A row is doubtful if, of the classes whose
    threshold its probability reaches, the most probable (the least on ties) isn't its label; margin = p[label] - p[suggested].
    Classes with fewer than `least` rows are left out.
    """
    own = F.get(p, F.col(label))
    th = probs.groupBy(label).agg(F.avg(own).alias("t"), F.count("*").alias("n")).where(F.col("n") >= least)  # one row per class
    top = th.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("k"), "t"))).alias("ts"))
    j = probs.join(F.broadcast(th.select(label)), label).crossJoin(F.broadcast(top))
    fit = F.filter("ts", lambda x: F.get(p, x["k"]) >= x["t"])
    best = F.array_min(F.transform(fit, lambda x: F.struct((-F.get(p, x["k"])).alias("m"), x["k"].alias("k"))))
    j = j.withColumn("_s", best["k"]).where(F.col("_s").isNotNull() & (F.col("_s") != F.col(label)))
    return j.select(key, label, F.col("_s").alias("suggested"), (F.get(p, F.col(label)) - F.get(p, F.col("_s"))).alias("margin"))


def trimmed(start: Column, stop: Column, entity: Column, signs: str = ".,;:-") -> tuple[Column, Column]:
    """Start and stop without one sign of `signs` at either end; an empty entity stays as it is."""
    first = F.when((F.length(entity) > 0) & F.lit(signs).contains(F.substring(entity, 1, 1)), 1).otherwise(0)
    last = F.when((F.length(entity) > 1) & F.lit(signs).contains(F.substring(entity, -1, 1)), 1).otherwise(0)
    return start + first, stop - last
