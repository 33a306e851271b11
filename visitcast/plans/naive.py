"""The naive plan, kept as a baseline: one group-by and one join per feature,
as the modelled code does (with the origin as a key instead of a loop).

Used by the equivalence test and by the bench to measure the fused plan
against it.  Not for production use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import feat_agg
from ..session import ensure_checkpoint_dir
from .features import W8_CATALOGUE, FeatureJob


def naive_w8(job: FeatureJob, index: int) -> DataFrame:
    keys, prefix, stats = W8_CATALOGUE[index]
    ensure_checkpoint_dir(job.labels.sparkSession)
    k = ["origin", *keys]
    out = job.labels
    names = []
    for w in job.windows:
        sel = job.hist.where(F.col("day_gap") >= -w)
        for s in stats:
            name = f"{prefix}_{s}_{w}"
            out = feat_agg(out, sel, k, "visitors", s, name, fill_all=False)
            names.append(name)
        # a plan of ~50 chained joins exhausts task memory; cut it per window
        out = out.checkpoint(eager=True)
    return out.select("origin", "store_id", "visit_date", *names)
