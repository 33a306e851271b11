"""The k-th row of a total order, exactly, without sorting.

The order is that of some columns, nulls first.  A pass counts the rows of
``BINS`` value ranges of the column at hand, with the smallest and largest value
of each; the range that holds the k-th row is cut again, and a range of one value
goes on with the next column.  Once a range has at most ``FETCH`` rows, they are
fetched and the k-th is looked up.  Several cut points share the passes.  Only
counts and those few rows reach the driver, nothing is shuffled but counts, and
the rows are then picked by a filter (``up_to``).
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = dt.date(1970, 1, 1)
BINS = 4096
FETCH = 4096


@dataclass
class _Cursor:
    """Rows that share ``fixed`` values of the first columns and lie between
    ``low`` and ``high`` in the next one; the wanted row is number ``k``."""

    k: int
    among: Column | None
    fixed: list = field(default_factory=list)
    low: object = None
    high: object = None
    n: int | None = None
    found: tuple | None = None

    def rows(self, order: Sequence[str]) -> Column:
        out = F.lit(True) if self.among is None else self.among
        for c, v in zip(order, self.fixed):
            out = out & F.col(c).eqNullSafe(F.lit(v))
        if self.low is not None:
            out = out & F.col(order[len(self.fixed)]).between(F.lit(self.low), F.lit(self.high))
        return F.coalesce(out, F.lit(False))


def _bin(name: str, kind: T.DataType, low, high) -> Column:
    """A number below BINS that never falls while the value rises; the values
    ``low`` and ``high`` get different ones."""
    c = F.col(name)
    if isinstance(kind, T.StringType):
        common = len(os.path.commonprefix([low.encode(), high.encode()]))
        two = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), common + 1, 2)), 4, "0")
        # A value that ends here comes before one that goes on with a zero byte.
        code = F.conv(two, 16, 10).cast("long") * 3 + F.least(F.octet_length(c) - common, F.lit(2))
        return code        # at most 3 * 65536 of them
    if isinstance(kind, T.DateType):
        c, low, high = F.unix_date(c), (low - _EPOCH).days, (high - _EPOCH).days
    elif isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(low, int) and high - low < 1 << 53:
        share = (c.cast("long") - F.lit(low)) / F.lit(float(high - low))
    else:
        share = (c.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1))


def _key(row) -> tuple:
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def cut_points(df: DataFrame, order: Sequence[str], ranks: dict[str, int],
               among: dict[str, Column] | None = None) -> dict[str, tuple | None]:
    """The values of ``order`` in row number ``ranks[name]`` (from 1), among
    the rows that satisfy ``among[name]``; None if there are fewer rows.

    Columns may be integral, floating (without infinities), dates, booleans or
    strings.  ``df`` is read once per pass: pass a checkpoint of the columns.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cursors = {name: _Cursor(k, (among or {}).get(name)) for name, k in ranks.items() if k > 0}
    names = list(cursors)
    while True:
        due = [n for n in names if cursors[n].found is None and cursors[n].k > 0]
        if not due:
            break
        jobs = []
        for n in due:
            cur = cursors[n]
            inside = cur.rows(order)
            if cur.n is not None and (cur.n <= FETCH or len(cur.fixed) == len(order)):
                continue
            column = order[len(cur.fixed)]
            value = F.lit(0) if cur.low is None else _bin(column, kinds[column], cur.low, cur.high)
            # Bin -1: nulls; without a range so far all other values are bin 0.
            jobs.append((n, column, df.where(inside).select(F.lit(n).alias("cursor"), F.when(F.col(column).isNull(), -1)
                                                            .otherwise(value).cast("long").alias("bin"), F.col(column).alias("v"))))
        if jobs:
            _narrow(jobs, cursors)
            continue
        for n in due:
            cur = cursors[n]
            rows = sorted((tuple(r) for r in df.where(cur.rows(order)).select(*order).limit(FETCH if len(cur.fixed) < len(order) else 1)
                           .collect()), key=_key)
            cur.found = rows[min(cur.k, len(rows)) - 1] if rows else None
            if not rows:
                cur.k = 0
    return {n: cursors[n].found if n in cursors else None for n in ranks}


def _narrow(jobs, cursors) -> None:
    """One pass: every cursor moves into the bin that holds its row."""
    for kind in {c for _, c, _ in jobs}:           # cursors on the same column share a job
        counted = None
        for _, column, part in jobs:
            if column == kind:
                counted = part if counted is None else counted.unionByName(part)
        bins: dict[str, list] = {}
        for r in counted.groupBy("cursor", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            bins.setdefault(r["cursor"], []).append(r)
        for name, column, _ in jobs:
            if column != kind:
                continue
            cur = cursors[name]
            for r in sorted(bins.get(name, []), key=lambda r: r["bin"]):
                if cur.k <= r["n"]:
                    cur.n = r["n"]
                    if r["low"] == r["high"]:       # one value (or null): on to the next column
                        cur.fixed, cur.low, cur.high = [*cur.fixed, r["low"]], None, None
                    else:
                        cur.low, cur.high = r["low"], r["high"]
                    break
                cur.k -= r["n"]
            else:
                cur.k = 0                           # fewer rows than the rank


def up_to(order: Sequence[str], point: tuple) -> Column:
    """Rows at or before a cut point (never null)."""
    out = F.lit(True)
    for c, v in reversed(list(zip(order, point))):
        before = F.col(c).isNull() if v is None else F.coalesce(F.col(c) < F.lit(v), F.lit(True))
        same = F.col(c).eqNullSafe(F.lit(v))
        out = (F.lit(False) if v is None else before & ~same) | (same & out)
    return out
