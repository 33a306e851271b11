"""URL filter: rules first, then a path-template tree per host.

1. Host and path are cut from the url by built-in expressions; the rule table
   (a parameter) becomes one CASE expression, longest rule first.
2. Paths become templates, level by level from the root, as long as a template
   has ``min_support`` pages and some of them go on.  A segment that looks
   generated (it has a digit) is the wildcard ``*``, as is a labelled literal of
   under ``min_support`` pages; an unlabelled one of so few is the wildcard ``?``;
   labelled literals that are statistically alike are merged into one branch ``{a,b}``: siblings
   are chained along their smoothed blocked shares, and a branch that differs
   from the pooled share of its chain by over ``z`` standard errors leaves it
   and is chained anew with the others that left, so a chain of small mixed
   branches cannot join opposites.  What lies below a template with too few
   pages shares its tail ``**``.
3. The pages a rule has judged are the labels.  The blocked share of a template
   is smoothed along its ancestors: towards the share of its parent, that
   towards the parent's parent, and at the root towards one half.  In an
   ancestor an unlabelled page counts as half a blocked one, so a branch that is
   blocked as a whole decides for what is new in it, while the labels of one
   branch say little about the unlabelled ones beside it.  Labels of the same
   path on other hosts count in the prior of a template, too.  It is rejected if
   the smoothed purity reaches ``reject_at``.

All statistics come from one pre-aggregation by (host, lexical template), so a
host with a third of all pages is a few rows per task from there on.  The
sibling windows hold a row per distinct blocked share, not per branch.

Defined results: a null url or one without ``://`` has empty host and path
and no rule (its template is the empty one); repeated rows are judged alike,
a null id stays null; other columns of the input are ignored, whatever their
names; with no labelled page nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

NAMED = 20                                # merged branches with all names in the template
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    action: str  # block or allow
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net"), UrlRule("allow", "example.net", "/en/"),
         UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_value(rules: tuple[UrlRule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        host = F.col("host")
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def lexical_segments(path: Column) -> Column:
    """Segments with generated ones (any digit) as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))


def purity(blocked: Column, labelled: Column, prior: Column, weight: float) -> Column:
    return (blocked + prior * weight) / (labelled + weight)


def inherited(n: Column, blocked: Column, labelled: Column, prior: Column, weight: float) -> Column:
    """Blocked share of a node for what is below it; unlabelled pages are half blocked."""
    return (blocked + (n - labelled) * 0.5 + prior * weight) / (n + weight)


def alike(literals: DataFrame, z: float, weight: float) -> DataFrame:
    """(host, template, branch, run): labelled siblings in runs of alike ones.

    The windows hold a row per distinct (blocked, labelled) of the siblings; in
    every round each run keeps at least its branch nearest to the pooled share,
    so the rounds end.
    """
    share = purity(F.col("blocked"), F.col("labelled"), F.lit(0.5), weight)
    here = ["host", "template"]
    shares = literals.groupBy(*here, "blocked", "labelled").agg(F.count(F.lit(1)).alias("siblings")) \
        .withColumn("share", share).withColumn("error2", F.col("share") * (1 - F.col("share")) / (F.col("labelled") + weight))
    left, settled, turn = checkpointed(shares), None, 0
    order = Window.partitionBy(*here).orderBy("share", "labelled")
    while not left.isEmpty():
        step = F.col("share") - F.lag("share").over(order)
        near = step <= z * F.sqrt(F.col("error2") + F.lag("error2").over(order))
        chained = left.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(order))
        run = Window.partitionBy(*here, "run")
        pooled = chained.withColumn("b", F.sum(F.col("blocked") * F.col("siblings")).over(run)) \
            .withColumn("l", F.sum(F.col("labelled") * F.col("siblings")).over(run))
        pooled = pooled.withColumn("p", purity(F.col("b"), F.col("l"), F.lit(0.5), weight))
        off = F.abs(F.col("share") - F.col("p"))
        limit = z * F.sqrt(F.col("error2") + F.col("p") * (1 - F.col("p")) / (F.col("l") + weight))
        nearest = F.row_number().over(run.orderBy(off, "share", "labelled")) == 1
        pooled = checkpointed(pooled.withColumn("stays", (off <= limit) | nearest))
        kept = pooled.where("stays").select(*here, "blocked", "labelled", F.concat_ws(".", F.lit(turn), "run").alias("run"))
        settled = kept if settled is None else settled.unionByName(kept)
        left = pooled.where("NOT stays").select(*left.columns)
        turn += 1
    if settled is None:
        return literals.select(*here, "branch", F.lit("").alias("run"))
    return literals.join(settled, [*here, "blocked", "labelled"]).select(*here, "branch", "run")


def template_tree(paths: DataFrame, min_support: int, z: float, weight: float) -> DataFrame:
    """Add template and prior to every (host, segs, n, blocked, labelled) row."""
    totals = paths.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("n", "blocked", "labelled")])
    root = inherited(F.col("h_n"), F.col("h_blocked"), F.col("h_labelled"), F.lit(0.5), weight)
    out = paths.join(totals, "host").select(
        *paths.columns, F.lit("").alias("template"), root.alias("prior"), root.alias("share"),
        ((F.col("h_n") >= min_support) & (F.size("segs") > 0)).alias("open"),
        ((F.col("h_n") < min_support) & (F.size("segs") > 0)).alias("tail"))
    out, level = checkpointed(out), 0
    most = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # unions would add up partitions
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]
    while not out.where("open").isEmpty():
        seg = F.get("segs", F.lit(level))
        here = out.where("open").groupBy("host", "template", seg.alias("seg")).agg(*sums)
        rare = (F.col("n") < min_support) & (F.col("seg") != "*")
        here = checkpointed(here.withColumn("branch", F.when(rare & (F.col("labelled") == 0), F.lit("?"))
                                            .when(rare, F.lit("*")).otherwise(F.col("seg"))))
        literals = here.where(~F.col("branch").isin("*", "?") & (F.col("labelled") > 0))
        runs = alike(literals.select("host", "template", "branch", "blocked", "labelled"), z, weight)
        siblings = runs.groupBy("host", "template", "run").agg(F.count(F.lit(1)).alias("siblings"), F.min("branch").alias("low"),
                                                               F.max("branch").alias("high"))
        siblings = siblings.where(F.col("siblings") > 1)
        many = runs.join(siblings, ["host", "template", "run"])
        # A long run is named by its ends and its number.
        names = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set("branch")), ","), F.lit("}"))
        short = many.where(F.col("siblings") <= NAMED).groupBy("host", "template", "run").agg(names.alias("merged"))
        long = many.where(F.col("siblings") > NAMED).select("host", "template", "run", F.concat(
            F.lit("{"), "low", F.lit(",?,"), "high", F.lit("}")).alias("merged")).distinct()
        merged = runs.join(short.unionByName(long), ["host", "template", "run"]).select("host", "template", "branch", "merged")
        named = here.join(merged, ["host", "template", "branch"], "left").withColumn("merged", F.coalesce("merged", "branch"))
        nodes = named.groupBy("host", "template", "merged").agg(*[F.sum(c).alias(f"h_{c}") for c in ("n", "blocked", "labelled")])
        named = named.select("host", "template", "seg", "merged").join(nodes, ["host", "template", "merged"])
        going = out.where("open").withColumn("seg", seg).join(named, ["host", "template", "seg"])
        deeper, enough = F.size("segs") > level + 1, F.col("h_n") >= min_support
        going = going.select(
            "host", "segs", "n", "blocked", "labelled", F.concat("template", F.lit("/"), "merged").alias("template"),
            F.when(deeper & ~enough, inherited(F.col("h_n"), F.col("h_blocked"), F.col("h_labelled"), F.col("share"), weight))
            .otherwise(F.col("share")).alias("prior"),
            inherited(F.col("h_n"), F.col("h_blocked"), F.col("h_labelled"), F.col("share"), weight).alias("share"),
            (deeper & enough).alias("open"), (deeper & ~enough).alias("tail"))
        out = checkpointed(out.where("NOT open").unionByName(going).coalesce(most))
        level += 1
    return out.withColumn("template", F.when(F.col("tail"), F.concat("template", F.lit("/**"))).otherwise(F.col("template"))) \
        .drop("open", "tail", "share")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES,
          min_support: int = 3, z: float = 1.96, weight: float = 2.0, reject_at: float = 0.8) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")) \
        .withColumn("rule", rule_value(rules, lambda r: r.name)) \
        .withColumn("action", rule_value(rules, lambda r: r.action)) \
        .withColumn("segs", lexical_segments(F.col("path")))
    paths = checkpointed(rows.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "block").alias("blocked"),
        F.count("action").alias("labelled")))
    tree = template_tree(paths, min_support, z, weight)
    overall = paths.groupBy("segs").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    tree = tree.join(overall, "segs").withColumn("prior", purity(F.col("b"), F.col("l"), F.col("prior"), weight))
    scores = tree.groupBy("host", "template").agg(
        F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"),
        (F.sum(F.col("prior") * F.col("n")) / F.sum("n")).alias("prior"))
    scores = scores.select("host", "template", purity(F.col("blocked"), F.col("labelled"), F.col("prior"), weight).alias("purity"))
    verdicts = tree.select("host", "segs", "template").join(scores, ["host", "template"]) \
        .select("host", "segs", "template", F.round("purity", 9).alias("purity"))
    return rows.join(verdicts, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")


def op10_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
