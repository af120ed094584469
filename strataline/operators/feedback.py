"""Story feedback: (story, seq, chapter, approach, five ratings, selected_best)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import APPROACHES, RATINGS


def average():
    return sum((F.col(r) for r in RATINGS), F.lit(0)) / len(RATINGS)


def by_approach(feedback: DataFrame) -> DataFrame:
    """Count, mean rating and best picks; approaches without feedback give zeros."""
    dim = feedback.sparkSession.createDataFrame([(a,) for a in APPROACHES], "approach string")
    g = feedback.groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.avg(average()).alias("average_rating"), F.count_if("selected_best").alias("best_selections"))
    return dim.join(g, "approach", "left").select("approach", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"),
                                                 F.coalesce("best_selections", F.lit(0)).alias("best_selections"))


def dimension_matrix(feedback: DataFrame) -> DataFrame:
    long = feedback.unpivot(["approach"], RATINGS, "dimension", "rating")
    return long.groupBy("dimension").pivot("approach", APPROACHES).agg(F.avg("rating")).na.fill(0.0)


def trends(feedback: DataFrame, n: int = 10) -> DataFrame:
    return feedback.orderBy(F.desc("seq")).limit(n).select("seq", "approach", average().alias("rating"))


def by_chapter(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("chapter").agg(F.avg(average()).alias("average"), F.count(F.lit(1)).alias("n"))


def step(weights: dict[str, float], approach: str, mean: float, best: bool, rate: float = 0.1, floor: float = 0.1) -> dict[str, float]:
    """One rating: move the weight of its approach, keep a floor, normalise."""
    at = approach if approach in weights else "hybrid"
    moved = {a: w + (rate * (mean - 3) / 2 + (0.05 if best else 0.0) if a == at else 0.0) for a, w in weights.items()}
    kept = {a: max(floor, w) for a, w in moved.items()}
    total = sum(kept.values())
    return {a: w / total for a, w in kept.items()}


START = {"unified": 0.33, "graph": 0.33, "hybrid": 0.34}


def learned_weights(feedback: DataFrame) -> DataFrame:
    """Weights per story after all its ratings, in order.

    Each step depends on the floor reached by the one before, so a story is
    read in sequence; it is streamed in sorted batches and only the three
    weights are held.
    """
    rows = feedback.select("story", "seq", "approach", F.greatest(F.lit(1.0), F.least(F.lit(5.0), average())).alias("mean"), "selected_best")
    rows = rows.repartition("story").sortWithinPartitions("story", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        story, w, n = None, dict(START), 0
        done = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.story != story:
                    if story is not None:
                        done.append((story, n, *w.values()))
                    story, w, n = r.story, dict(START), 0
                w, n = step(w, r.approach, r.mean, r.selected_best), n + 1
            if done:
                yield pd.DataFrame(done, columns=["story", "n", *START])
                done = []
        if story is not None:
            yield pd.DataFrame([(story, n, *w.values())], columns=["story", "n", *START])

    out = rows.mapInPandas(fold, "story long, n long, unified double, graph double, hybrid double")
    u, g, h = (F.round(a, 9) for a in APPROACHES)
    return out.withColumn("recommended", F.when((u >= g) & (u >= h), "unified").when(g >= h, "graph").otherwise("hybrid"))


def improvements(feedback: DataFrame) -> DataFrame:
    """Weak dimensions (mean below three, all approaches rated) and the best approach."""
    m = dimension_matrix(feedback)
    mean = sum((F.col(a) for a in APPROACHES), F.lit(0.0)) / len(APPROACHES)
    rated = F.lit(True)
    for a in APPROACHES:
        rated = rated & (F.col(a) > 0)
    weak = m.filter(rated & (mean < 3)).select(F.lit("weak_dimension").alias("kind"), F.col("dimension").alias("subject"), mean.alias("value"))
    order = F.array_position(F.array(*[F.lit(a) for a in APPROACHES]), F.col("approach"))
    best = by_approach(feedback).filter("average_rating > 0").agg(F.max_by(F.struct("approach", "average_rating"), F.struct("average_rating", -order)).alias("b"))
    return weak.unionByName(best.filter("b IS NOT NULL").select(F.lit("approach_recommendation").alias("kind"), F.col("b.approach").alias("subject"), F.col("b.average_rating").alias("value")))
