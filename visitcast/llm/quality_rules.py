"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression on the row (split, translate,
higher-order functions): no user function, no shuffle, one pass over the
whole text.  Repeated word triples are found by sorting the triples of the
row, so the cost of a text is n log n and no group leaves its row.

Defined results: a null text counts as empty; an empty text has no words and
fails the base rule; repeated rows are judged one by one; a null id stays
null; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, let

SYMBOLS = r"[#*$%&|<>]+"
BREAK_PATTERN = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this",
    "to", "was", "with",
    "auf", "das", "den", "der", "des", "die", "ein", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "de", "del", "el", "en", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y",
    "au", "dans", "du", "est", "et", "le", "les", "par", "pas", "pour", "qui", "sur", "une",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text unless low <= numerator / denominator <= high.

    The comparison is made on whole numbers (numerator * scale against
    bound * denominator), so it is exact.
    """

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None
    scale: int = 100

    def holds(self) -> str:
        parts = [f"{self.numerator} * {self.scale} {op} {bound} * {self.denominator}"
                 for op, bound in ((">=", self.low), ("<=", self.high)) if bound is not None]
        return "(" + " AND ".join(parts) + ")"


# Ratios in hundredths of the denominator.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 15),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BREAK_PATTERN), lambda w: w != "")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the counts the rules are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WORD_BREAKS, "") != "")
    counts = F.struct(
        let(word_array(text), _word_counts).alias("words"),
        let(lines, lambda found: F.struct(F.size(found).alias("n_lines"),
                                          (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines"))).alias("lines"),
        F.length(F.regexp_replace(text, BREAK_PATTERN, "")).alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        # Keeps conditions on the counts above this projection: pushed below
        # it they would compute everything once more per condition.
        F.monotonically_increasing_id().alias("row"))
    return docs.select(F.col(id_col).alias("doc_id"), counts.alias("c")).select(
        "doc_id", *[F.col(f"c.{name}").cast("long").alias(name.split(".")[-1]) for name in (
            "words.n_words", "word_chars", "n_symbols", "words.n_stop_words", "lines.n_lines", "lines.n_dup_lines",
            "words.n_repeat_words")])


def _word_counts(words: Column) -> Column:
    return F.struct(F.size(words).alias("n_words"),
                    F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
                    F.when(F.size(words) >= 3, let(_sorted_triples(words), _covered_words)).otherwise(F.lit(0))
                    .alias("n_repeat_words"))


def _sorted_triples(words: Column) -> Column:
    """(three words, place) of every window, equal windows side by side."""
    return F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
                           i.alias("i"))))


def _covered_words(triples: Column) -> Column:
    """Words in windows that stand twice or more."""
    last = F.size(triples) - 1

    def repeated(j):
        here = F.get(triples, j)["w"]
        return (((j > 0) & (here == F.get(triples, j - 1)["w"])) | ((j < last) & (here == F.get(triples, j + 1)["w"])))

    starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), repeated), lambda j: F.get(triples, j)["i"]))
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
          min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Counts, base verdict, final verdict and the names of the broken rules."""
    stats = statistics(docs, id_col, text_col)
    base = f"(n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words)"
    broken = [F.when(~F.expr(r.holds()), F.lit(r.name)) for r in rules]
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base).alias("base_failed"),
        F.expr(" AND ".join([f"NOT {base}", *(r.holds() for r in rules)])).alias("kept"),
        "n_stop_words", "n_lines",
        F.array_compact(F.array(*broken)).alias("broken_rules") if broken
        else F.array().cast("array<string>").alias("broken_rules"))


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    """Whole ``documents``; ``broken_rules`` stays in the operator's output."""
    from .common import table
    return judge(table(spark, sf_dir, "documents")).drop("broken_rules")
