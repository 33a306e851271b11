"""Filter interaction audit on failing-id relations.

One table of row ids per filter is stored in the shared folder.  The rows are
then split by one id table after the other: a left-semi join gives those that
fail the filter, a left-anti join those that pass, and both go on under a tag,
so after the last filter every row stands in the set of filters that it fails.
These sets are what all prefixes share: the survivors of a prefix are the sets
without any of its filters, the removals of the next filter the sets with it and
none before it, its redundant failures the sets with it and one before it.  Two
further splits by the ids of the labels give the label losses.  A row takes part
in two joins per filter whatever the number of orders, every join is on the
unique row id, so no key is hot, and only counts per set reach the report.

Copies: rows with equal texts are found by SHA-256; a group's smallest id is
aggregated before the shuffle, and groups with over 1 / HEAVY of all rows (fewer
than HEAVY of them) are looked up by a broadcast instead of a shuffle.

Defined results: a null text is empty; a null part counts as the empty string; a
row with null id is no copy of anything, has no label and is counted like any
other; rows that repeat an id are counted one by one and are no copies of each
other; an id that is labelled several times has every label it was given; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import checkpointed, let, table

BREAK_PATTERN = r"[\x20\x09-\x0D]+"
HEAVY = 1024

# A rule sees struct(text, n_words, n_distinct) and says whether the row fails.
RULES: dict[str, Callable[[Column], Column]] = {
    "A": lambda r: r["n_words"] < 200,
    "B": lambda r: 100 * r["n_distinct"] < 50 * r["n_words"],
    "C": lambda r: 100 * (F.length(r["text"]) - F.length(F.regexp_replace(r["text"], "[A-Z]+", ""))) > 3 * F.length(r["text"]),
    "D": lambda r: r["text"].rlike(r"[#$%&*|]"),
}
COPIES = "E"


def _facts(text: Column) -> Column:
    words = F.filter(F.split(text, BREAK_PATTERN), lambda w: w != "")
    return let(words, lambda w: F.struct(text.alias("text"), F.size(w).alias("n_words"),
                                         F.size(F.array_distinct(w)).alias("n_distinct")))


def judged(docs: DataFrame, rules: dict[str, Callable[[Column], Column]], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One narrow row per document: row id, id, part, text digest, the names of
    the rules it fails.  The only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = let(_facts(text), lambda r: F.concat_ws("", *[F.when(rule(r), F.lit(name)) for name, rule in rules.items()]))
    return checkpointed(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), fails.alias("fails")))


def copies(rows: DataFrame) -> DataFrame:
    """Row ids whose text a smaller id has, too."""
    rows = rows.where(F.col("id").isNotNull()).select("row", "id", "digest")
    groups = checkpointed(rows.groupBy("digest").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("n"))
                          .where(F.col("n") > 1))
    share = rows.count() / HEAVY
    heavy = groups.where(F.col("n") > share).select("digest", F.col("smallest").alias("heavy"))   # under HEAVY groups
    tagged = rows.join(F.broadcast(heavy), "digest", "left")
    rest = groups.where(F.col("n") <= share)
    return (tagged.where(F.col("heavy") < F.col("id")).select("row").unionByName(
        tagged.where(F.col("heavy").isNull()).join(rest, "digest").where(F.col("smallest") < F.col("id")).select("row")))


def failing_sets(rows: DataFrame, relations: list[DataFrame]) -> DataFrame:
    """(row, part, failed): bit i is set for rows in relation i."""
    found = rows.select("row", "part", F.lit(0).alias("failed"))
    parts = rows.rdd.getNumPartitions()        # both halves of a split together have as many again
    for i, ids in enumerate(relations):
        hit = found.join(ids, "row", "left_semi").withColumn("failed", F.col("failed") + (1 << i))
        found = checkpointed(hit.unionByName(found.join(ids, "row", "left_anti")).coalesce(parts))
    return found


def report(sets: DataFrame, names: list[str]) -> DataFrame:
    """The audit of every order from counts (part, failed, good, toxic, n) per
    failed set.  ``names`` are few: their orders are listed."""
    bits = {name: 1 << i for i, name in enumerate(names)}
    steps = [f"struct({sum(bits[x] for x in before)} AS before, '{name}' AS filter, {bits[name]} AS bit)"
             for name in names for k in range(len(names)) for before in combinations([x for x in names if x != name], k)]
    each = sets.select("part", "failed", "good", "toxic", "n", F.expr(f"inline(array({', '.join(steps)}))"))
    here, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = {
        "kept": ~here & ~earlier, "removed": here & ~earlier, "redundant": here & earlier,
        "unique_fails": F.col("failed") == F.col("bit"), "good_lost": here & ~earlier & F.col("good"),
        "toxic_lost": here & ~earlier & F.col("toxic")}
    after = each.groupBy("part", "before", "filter").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in total.items()])
    orders = sets.sparkSession.createDataFrame(
        [("".join(order), step + 1, sum(bits[x] for x in order[:step]), name)
         for order in permutations(names) for step, name in enumerate(order)],
        "filter_order string, step int, before int, filter string")
    audit = after.join(F.broadcast(orders), ["before", "filter"])
    shapley = audit.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return audit.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", *total, "shapley", "filter")


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column], Column]] = RULES, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Every order of ``rules`` and the copy filter, step by step."""
    spark = docs.sparkSession
    rows = judged(docs, rules, id_col, text_col, part_col)
    folder = f"{ensure_checkpoint_dir(spark)}/filter_audit-{uuid.uuid4().hex}"
    stored = {name: rows.where(F.col("fails").contains(name)).select("row") for name in rules} | {COPIES: copies(rows)}
    for name, ids in stored.items():
        ids.write.parquet(f"{folder}/{name}")
    tables = [spark.read.parquet(f"{folder}/{name}") for name in stored]
    labelled = [rows.select("row", "id").join(labels.where(F.col(c) == 1).select(F.col("doc_id").alias("id")), "id", "left_semi")
                .select("row") for c in ("quality", "toxic")]
    k = len(stored)
    sets = failing_sets(rows, tables + labelled).groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"))
    sets = sets.select("part", "n", F.col("failed").bitwiseAND(F.lit((1 << k) - 1)).alias("failed"),
                       (F.col("failed").bitwiseAND(F.lit(1 << k)) != 0).alias("good"),
                       (F.col("failed").bitwiseAND(F.lit(2 << k)) != 0).alias("toxic"))
    return report(checkpointed(sets), list(stored))


def op12_filter_audit(spark, sf_dir) -> DataFrame:
    """All ``documents``, all orders of the five filters."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
