"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

Sequential covering: a rule is grown by adding the threshold condition with the
largest information gain on two thirds of the labelled rows, cut back on the
other third, and kept while it is precise there; rows it covers leave. Each step
is one aggregate over a narrow table of statistics; the driver sees counts per
feature and grid cell. The result is an ordered SQL CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.session import cut_lineage

#: Features that rules may use; integers, percentages rounded down.
FEATURES = ["n_words", "symbol_pct", "dup_line_pct", "repeat_pct", "distinct_pct", "mean_word_chars_pct"]
#: Grid lines per doubling of a feature.
STEPS = 8
MIN_PRECISION, MIN_COVERED = 0.9, 5

_SPACE = "' \\t\\n\\u000B\\f\\r'"


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts over whole texts, one row per row; null is empty and an empty text has zeros.

    word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines:
    lines with a word that equal an earlier one; n_repeat_words: words in 5-word windows that occur twice or more in the text.
    """
    d = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.expr(r"array_remove(split(_text, '[ \\t-\\r]+'), '')"))
    d = d.select(
        "_id",
        F.expr("transform(_words, w -> xxhash64(w))").alias("_hashes"),
        F.expr("cast(size(_words) AS bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(_words, '')) AS bigint)").alias("word_chars"),
        F.expr(r"cast(size(split(_text, '[#*$%&|<>]', -1)) - 1 AS bigint)").alias("n_symbols"),
        F.expr(f"filter(split(_text, '\\n', -1), l -> trim(BOTH {_SPACE} FROM l) <> '')").alias("_lines"),
    )
    d = d.select(
        "_id", "n_words", "word_chars", "n_symbols",
        F.expr("cast(size(_lines) AS bigint)").alias("n_lines"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) AS bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(_hashes)) AS bigint)").alias("n_distinct_words"),
        F.expr("""CASE WHEN n_words >= 5 THEN transform(sequence(0, cast(n_words AS int) - 5),
            i -> xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2], _hashes[i + 3], _hashes[i + 4])) ELSE cast(array() AS array<bigint>) END""").alias("_windows"),
    )
    # Only texts with a repeated window have theirs sorted.
    d = d.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END"))
    d = d.withColumn("_again", F.expr("""sort_array(transform(filter(_sorted, (s, k) -> (k > 0 AND _sorted[greatest(k - 1, 0)].h = s.h) OR (k < size(_sorted) - 1 AND _sorted[least(k + 1, size(_sorted) - 1)].h = s.h)), s -> s.i))"""))
    repeat = "aggregate(transform(_again, (p, k) -> CASE WHEN k < size(_again) - 1 THEN least(5, _again[least(k + 1, size(_again) - 1)] - p) ELSE 5 END), 0L, (a, x) -> a + x)"
    return d.select(F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(repeat).alias("n_repeat_words"), "n_distinct_words")


def with_features(stats: DataFrame) -> DataFrame:
    """The statistics with base_failed and the features of the rules."""
    percent = lambda part, whole: F.expr(f"CASE WHEN {whole} > 0 THEN (100 * {part}) DIV {whole} ELSE 0L END")
    return (
        stats.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
        .withColumn("symbol_pct", percent("n_symbols", "n_words"))
        .withColumn("dup_line_pct", percent("n_dup_lines", "n_lines"))
        .withColumn("repeat_pct", percent("n_repeat_words", "n_words"))
        .withColumn("distinct_pct", percent("n_distinct_words", "n_words"))
        .withColumn("mean_word_chars_pct", percent("word_chars", "n_words"))
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, with the rejected and the other rows it covers in the pruning part."""

    conditions: tuple[Condition, ...]
    covered: int
    wrong: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def line(cell: int) -> int:
    """The smallest integer in a grid cell."""
    return math.ceil(2 ** (cell / STEPS) - 1 - 1e-6)


def _cell(feature: str) -> str:
    return f"cast(floor({STEPS} * log2(1 + {feature}) + 1e-9) AS int)"


def _information(p: float, n: float) -> float:
    return math.log2(p / (p + n)) if p else -60.0


def best_condition(counts: dict[str, dict[int, tuple[int, int]]], used: tuple[Condition, ...]) -> tuple[float, Condition] | None:
    """The condition with the largest gain; counts: (rejected, others) by feature and cell. Ties: the first feature, then the lowest line."""
    best = None
    for feature in FEATURES:
        cells = sorted(counts.get(feature, {}))
        p = sum(counts[feature][c][0] for c in cells) if cells else 0
        n = sum(counts[feature][c][1] for c in cells) if cells else 0
        below_p = below_n = 0
        for before, cell in zip(cells[:-1], cells[1:], strict=True):
            below_p, below_n = below_p + counts[feature][before][0], below_n + counts[feature][before][1]
            for at_least, (a, b) in ((True, (p - below_p, n - below_n)), (False, (below_p, below_n))):
                gain = a * (_information(a, b) - _information(p, n))
                condition = Condition(feature, at_least, line(cell))
                if a and gain > 1e-9 and condition not in used and (best is None or gain > best[0] + 1e-9):
                    best = (gain, condition)
    return best


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for rows with ``rejected`` from a table (part, rejected, features); part < 2 grows, 2 prunes. A table without rejected rows gives none.

    Conditions are added as long as one gains. What a rule covers that fails pruning is set aside, and covering goes
    on until a rule covers fewer than ``MIN_COVERED`` rejected rows where it grew.
    """
    rules: list[Rule] = []
    aside: list[str] = []
    while True:
        left = labelled.where(" AND ".join(f"NOT ({r.sql()})" for r in rules)) if rules else labelled
        growing = left.where("part < 2")
        growing = growing.where(" AND ".join(f"NOT ({a})" for a in aside)) if aside else growing
        conditions: tuple[Condition, ...] = ()
        while True:
            grown = growing
            grown = grown.where(" AND ".join(c.sql() for c in conditions)) if conditions else grown
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(_cell(f)).alias("cell")) for f in FEATURES]))
            found = grown.select("rejected", cells.alias("x")).groupBy("x.feature", "x.cell").agg(F.sum(F.col("rejected").cast("long")).alias("p"), F.sum((~F.col("rejected")).cast("long")).alias("n"))
            counts: dict[str, dict[int, tuple[int, int]]] = {}
            for row in found.collect():  # at most the features times the lines of the grid
                counts.setdefault(row["feature"], {})[row["cell"]] = (row["p"], row["n"])
            best = best_condition(counts, conditions)
            if best is None:
                break
            conditions = (*conditions, best[1])
        whole = " AND ".join(c.sql() for c in conditions)
        if not conditions or growing.where(whole).where("rejected").limit(MIN_COVERED).count() < MIN_COVERED:
            break
        heads = [" AND ".join(c.sql() for c in conditions[: k + 1]) for k in range(len(conditions))]
        sums = [F.sum(F.expr(f"cast({h} AND {'NOT ' * (not hit)}rejected AS bigint)")).alias(f"c{k}_{int(hit)}") for k, h in enumerate(heads) for hit in (True, False)]
        tested = left.where("part = 2").agg(*sums).first()
        scored = [(tested[f"c{k}_1"] or 0, tested[f"c{k}_0"] or 0, k) for k in range(len(heads))]
        p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]) if x[0] + x[1] else -2, -x[2]))
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            aside.append(whole)
            continue
        rules.append(Rule(conditions[: k + 1], p, n))
    return rules


def case_expression(rules: list[Rule]) -> str:
    """The ordered list as SQL: the number of the first rule that holds, 0 if none does."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(rules, 1)) + " ELSE 0 END" if rules else "0"


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics, base_failed, the number of the rule that rejects a row (0: none) and kept, per row.

    Rules are learned from all labelled rows (``quality`` 0 rejected, 1 not) that pass
    the base rule; null labels and ids are left out of learning and rows with them still get a verdict.
    Without any labels there are no rules. Repeated rows are judged each.
    """
    made = cut_lineage(with_features(text_statistics(docs, id_column, text_column)))
    marks = labels.where("quality IS NOT NULL").groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("quality"))
    joined = made.where("NOT base_failed").join(marks, F.col(id_column) == F.col("_id"))
    labelled = cut_lineage(joined.select((F.col("quality") == 0).alias("rejected"), F.pmod(F.xxhash64(F.col(id_column)), F.lit(3)).alias("part"), *FEATURES))
    rules = learn(labelled)
    return made.withColumn("rule", F.expr(case_expression(rules))).withColumn("kept", F.expr("NOT base_failed AND rule = 0"))
