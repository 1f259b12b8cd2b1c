"""Answers held against the truth: coverage, precision, accuracy, by any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def tally(*by: str) -> list[Column]:
    """Aggregates over rows with ``answer`` and ``truth``: counts and rates; a null answer is no answer."""
    n, answered = F.count("*"), F.count("answer")
    right = F.count_if(F.col("answer") == F.col("truth"))
    coverage, precision = ratio(answered, n), ratio(right, answered)
    return [
        n.alias("scored"),
        answered.alias("answered"),
        right.alias("correct"),
        coverage.alias("coverage"),
        precision.alias("precision"),
        ratio(right, n).alias("accuracy"),
        ratio(answered - right, n).alias("wrong"),
    ]


def scored(answers: DataFrame, by: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """The tally by ``by``; with ``totals`` also of all coarser groupings (null for what is summed up)."""
    grouped = answers.rollup(*by) if totals else answers.groupBy(*by)
    return grouped.agg(*tally())


def best_overlap(questions: DataFrame, spans: DataFrame, on: Sequence[str], q: tuple[str, str], s: tuple[str, str], value: Column, order: Sequence[str], to: str) -> DataFrame:
    """``questions`` with ``to``: ``value`` of the span that overlaps most (more than nothing), the first by ``order`` of equals.

    Questions need a column ``qid``. Half-open ranges meet through the equal keys ``on``.
    """
    shared = F.least(q[1], s[1]) - F.greatest(q[0], s[0])
    met = questions.join(spans, list(on)).where(shared > 0)
    best = met.groupBy("qid").agg(F.max_by(value, F.struct(shared, *[-F.col(o) for o in order])).alias(to))
    return questions.join(best, "qid", "left")
