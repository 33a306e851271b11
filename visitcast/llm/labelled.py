"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def learnable(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of labelled ids outside the held-out fold.

    Null ids and null labels are left out; an id that is labelled several
    times counts once, with its largest label.
    """
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
            .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))


def training_sample(labelled: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids of either class, in the order of a hash of the
    id, and the class totals (for the prior)."""
    totals = {int(r["y"]): int(r["n"]) for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
              if r["y"] in (0, 1)}
    parts = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), totals


def prior_shift(sample: tuple[int, int], totals: dict[int, int]) -> float:
    """Log-odds to add to a model of the sample so that it holds for all rows."""
    import math

    if min(*sample, totals.get(0, 0), totals.get(1, 0)) == 0:
        return 0.0
    return math.log(totals[1] / totals[0]) - math.log(sample[1] / sample[0])


def rows_of(lists) -> list:
    """The rows of an Arrow column of lists as numpy views (no copy)."""
    column = lists.combine_chunks()
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at, at[1:])]
