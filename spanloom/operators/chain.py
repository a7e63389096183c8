"""Linear-chain scores over rows of emissions: best path and log-likelihood, native in Spark's array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(transitions: list[list[float]], starts: list[float], ends: list[float]) -> int:
    n = len(starts)
    if n == 0 or len(ends) != n or len(transitions) != n or any(len(r) != n for r in transitions):
        raise ValueError("transitions must be square and starts and ends of their size")
    return n


def viterbi(emissions: Column, transitions: list[list[float]], starts: list[float], ends: list[float]) -> Column:
    """struct(score, path) of the best label path over array<array<double>> emissions; on ties the lowest label last.

    One fold over the steps keeps each label's best score and path. An empty or null array of steps gives null.
    """
    n = _check(transitions, starts, ends)
    first = F.get(emissions, 0)
    zero = F.array(*[F.struct((F.get(first, j) + F.lit(starts[j])).alias("s"), F.array(F.lit(j)).alias("p")) for j in range(n)])

    def step(acc: Column, e: Column) -> Column:
        def best(j: int) -> Column:
            s = F.array(*[F.struct((F.get(acc, i)["s"] + F.lit(transitions[i][j])).alias("s"), F.lit(-i).alias("k")) for i in range(n)])
            top = F.array_max(s)
            return F.struct((top["s"] + F.get(e, j)).alias("s"), F.concat(F.get(acc, -top["k"])["p"], F.array(F.lit(j))).alias("p"))

        return F.array(*[best(j) for j in range(n)])

    def last(acc: Column) -> Column:
        top = F.array_max(F.array(*[F.struct((F.get(acc, j)["s"] + F.lit(ends[j])).alias("s"), F.lit(-j).alias("k")) for j in range(n)]))
        return F.struct(top["s"].alias("score"), F.get(acc, -top["k"])["p"].alias("path"))

    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))
    return F.when(F.size(emissions) > 0, F.aggregate(rest, zero, step, last))


def log_likelihood(emissions: Column, tags: Column, transitions: list[list[float]], starts: list[float], ends: list[float]) -> Column:
    """Log-probability of the tag path; null for an empty or null array of steps."""
    n = _check(transitions, starts, ends)
    t = F.array(*[F.array(*[F.lit(x) for x in r]) for r in transitions])
    at = lambda a, i: F.get(a, i)
    steps = F.sequence(F.lit(0), F.size(emissions) - 1)
    own = F.aggregate(
        F.transform(steps, lambda i: at(at(emissions, i), at(tags, i)) + F.when(i > 0, at(at(t, at(tags, i - 1)), at(tags, i))).otherwise(at(F.array(*[F.lit(x) for x in starts]), at(tags, 0)))), F.lit(0.0), lambda a, x: a + x
    ) + at(F.array(*[F.lit(x) for x in ends]), at(tags, F.size(emissions) - 1))
    log_sum = lambda v: F.array_max(v) + F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - F.array_max(v))), F.lit(0.0), lambda a, x: a + x))
    zero = F.array(*[at(at(emissions, 0), j) + F.lit(starts[j]) for j in range(n)])
    step = lambda acc, e: F.array(*[log_sum(F.array(*[at(acc, i) + F.lit(transitions[i][j]) for i in range(n)])) + at(e, j) for j in range(n)])
    rest = F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0)))
    norm = F.aggregate(rest, zero, step, lambda acc: log_sum(F.array(*[at(acc, j) + F.lit(ends[j]) for j in range(n)])))
    return F.when(F.size(emissions) > 0, own - norm)


def reduced(df: DataFrame, llh: str, steps: str, how: str) -> DataFrame:
    """Log-likelihoods as they are ('none'), their 'sum', 'mean', or the sum over all steps' number ('token_mean')."""
    if how not in ("none", "sum", "mean", "token_mean"):
        raise ValueError(f"unknown reduction {how!r}")
    if how == "none":
        return df.select(llh)
    of = {"sum": F.sum(llh), "mean": F.avg(llh), "token_mean": F.try_divide(F.sum(llh), F.sum(steps))}[how]
    return df.agg(of.alias(llh))
