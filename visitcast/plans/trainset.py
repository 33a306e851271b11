"""Training sets: split, weights, unions (K1, M1, M2, M8, M9)."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import weights as W
from ..operators.joins import domain_split
from ..operators.selection import numeric_feature_columns, time_split
from ..sources import tables
from . import features as FP


@dataclass
class DomainData:
    source_train: DataFrame
    target_train: DataFrame
    source_test: DataFrame
    target_test: DataFrame
    features: list[str]
    shared: dict = field(default_factory=dict)      # frames and scores that several fits use
    making: threading.RLock = field(default_factory=threading.RLock)

    def once(self, name: str, make: Callable):
        """What ``make`` returns, made by the first of the threads that ask."""
        with self.making:
            if name not in self.shared:
                self.shared[name] = make()
            return self.shared[name]


def domain_frames(feature_table: DataFrame, relation: DataFrame, test_begin=tables.TEST_BEGIN) -> DomainData:
    """J5 + split: target stores are those in the id relation."""
    train, test = FP.split(feature_table, test_begin)
    t_tr, s_tr = domain_split(train, relation, "store_id", "source_id")
    t_te, s_te = domain_split(test, relation, "store_id", "source_id")
    return DomainData(s_tr, t_tr, s_te, t_te, numeric_feature_columns(feature_table))


def weighted_set(train: DataFrame, valid_days: int = 7, gap_col: str = "day_gap") -> DataFrame:
    """M2: K1 split + M1 recency weights normalized within train and valid."""
    return W.recency_weight(time_split(train, "visit_date", valid_days), gap_col, "is_valid")


def pseudo_union_a(source: DataFrame, target_pred: DataFrame, label: str = "visitors",
                   prediction: str = "prediction", gap_col: str = "day_gap") -> DataFrame:
    """M8: source rows with their labels and weight 1, target rows labelled by
    a model's prediction and weighted 1/(1+|gap|) over their mean."""
    s = source.withColumn("weight", F.lit(1.0)).withColumn("domain", F.lit("source"))
    t = (target_pred.withColumn(label, F.col(prediction)).select(*source.columns)
         .withColumn("weight", F.lit(1.0) / (F.lit(1.0) + F.abs(F.col(gap_col)))))
    t = W.normalize_by_part_mean(t, "weight", None).withColumn("domain", F.lit("target"))
    return s.unionByName(t)


def pseudo_union_b(target: DataFrame, target_pred: DataFrame, label: str = "visitors",
                   prediction: str = "prediction") -> DataFrame:
    """M9: target rows plus a copy of them labelled by the prediction."""
    copy = target_pred.withColumn(label, F.col(prediction)).drop(prediction).withColumn("pseudo", F.lit(True))
    return target.withColumn("pseudo", F.lit(False)).unionByName(copy.select(*target.columns, "pseudo"))
