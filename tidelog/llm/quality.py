"""Quality rules: a decision list learned by sequential covering, applied as ordered conditional expressions.

Everything on the data runs as DataFrame functions. Learning reads the labelled rows' features (at most TRAIN_ROWS rows,
those with the smallest hashed ids) and works on their statistics: each rule for the low-quality class grows by the
threshold condition of the highest information gain on two thirds of the rows, is pruned backwards on the other third, and
is kept if it is precise enough there; rows it covers are set aside and the next rule is grown. The list becomes one
chained CASE expression, so the first matching rule names its rejection.

Words are runs of characters other than space and \\t to \\r. Nulls: a null text has no words (and fails the base rules);
labels with null id or quality are no labels; a document labelled twice counts with its lower quality; of several texts of
a labelled id, the one with the smallest hash is learned from. Repeated documents
stay. Extra columns are carried along, except that names of features are replaced. An empty table gives an empty result. Without labels of both classes no
rules are learned and the base rules decide alone. Texts of any length count whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SPACES, let

WINDOW = 8
# The bound of the training sample.
TRAIN_ROWS = 20_000
# Cut points of a feature that conditions are tried at, rules of a list, and conditions of a rule.
QUANTILES = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
# A rule stays if at least this share of what it covers of the pruning rows is of low quality.
PRECISION = 0.9
LEAST_COVERED = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_shouts", "n_bars", "n_distinct", "n_lines", "n_digits", "n_doubled")


def without(text: Column, signs: str) -> Column:
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice, from the words' hashes."""
    last = F.size(hashes) - WINDOW
    window = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(order: Column) -> Column:
            same = F.filter(
                order,
                lambda x, j: (x["h"] == F.get(order, j - 1)["h"]) | (x["h"] == F.get(order, j + 1)["h"]),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(starts: Column) -> Column:
            steps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(placed, twice), total)

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    return F.when(last >= 1, let(window, counted)).otherwise(0).cast("long")


def with_features(documents: DataFrame) -> DataFrame:
    """The documents with COUNTS, MORE and base_failed; each text is taken apart once, in one generated row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(without(line, " \t\x0b\x0c\r")) > 0)
    words = F.filter(F.split(text, SPACES), lambda word: word != "")
    long = {
        "word_chars": F.length(without(text, " \t\n\x0b\x0c\r")),
        "n_symbols": F.length(text) - F.length(without(text, "#*$%&|<>")),
        "n_upper": F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "n_shouts": F.length(text) - F.length(without(text, "!")),
        "n_bars": F.length(text) - F.length(without(text, "|")),
        "n_digits": F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", "")),
    }
    by_line = let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))

    def of_words(hashes: Column) -> Column:
        follows = F.filter(hashes, lambda h, i: h == F.get(hashes, i - 1))
        return F.struct(
            F.size(hashes).alias("n_words"),
            F.size(F.array_distinct(hashes)).alias("n_distinct"),
            F.size(follows).alias("n_doubled"),
            repeated_words(hashes).alias("n_repeat_words"),
        )

    by_word = let(F.transform(words, lambda word: F.xxhash64(word)), of_words)
    row = F.struct(*[value.alias(name) for name, value in long.items()], by_line.alias("by_line"), by_word.alias("by_word"))
    clear = documents.drop(*[c for c in documents.columns if c in (*COUNTS, *MORE, "base_failed", "features")])
    found = clear.select("*", F.explode(F.array(row)).alias("features"))
    inner = {name: f"features.{name}" for name in long}
    inner |= {name: f"features.by_line.{name}" for name in ("n_lines", "n_dup_lines")}
    inner |= {name: f"features.by_word.{name}" for name in ("n_words", "n_distinct", "n_doubled", "n_repeat_words")}
    found = found.select(*clear.columns, *[F.col(inner[name]).cast("long").alias(name) for name in (*COUNTS, *MORE)])
    return found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def ratios() -> dict[str, Column]:
    """The quantities that rules put thresholds on."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    named = {
        "words": F.col("n_words"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "bars_per_word": F.col("n_bars") / words,
        "shouts_per_word": F.col("n_shouts") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "distinct_share": F.col("n_distinct") / words,
        "doubled_share": F.col("n_doubled") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
    }
    return {name: value.cast("double") for name, value in named.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        value = ratios()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def labelled(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(features, low) of at most `rows` labelled documents, those with the smallest hashed ids."""
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") <= 0).alias("low"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = sample.select(F.col("doc_id").alias("label_id"), "low")
    # The sample has at most `rows` rows of 9 bytes.
    met = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    one = met.groupBy("doc_id", "low").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = with_features(one)
    return found.where("not base_failed").select("low", F.xxhash64("doc_id").alias("draw"), *[v.alias(k) for k, v in ratios().items()])


def learn(table: dict[str, np.ndarray], low: np.ndarray, grow: np.ndarray) -> list[Rule]:
    """The decision list for rows with `low`; `grow` marks the growing rows, the rest prune."""
    candidates = [
        Condition(name, above, float(cut))
        for name, values in table.items()
        for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, QUANTILES)).round(6) if len(values) else [])
        for above in (True, False)
    ]
    holds = {c: c.holds(table) for c in candidates}
    left = np.ones(len(low), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _prune(_grow(candidates, holds, left & grow, low), holds, left & ~grow, low)
        if not rule:
            break
        covered = left & _meets(rule, holds, len(low))
        judge = covered & ~grow
        if covered.sum() < LEAST_COVERED or (low & judge).sum() < PRECISION * max(1, judge.sum()):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _meets(rule: Rule, holds: dict[Condition, np.ndarray], size: int) -> np.ndarray:
    met = np.ones(size, bool)
    for condition in rule:
        met &= holds[condition]
    return met


def _grow(candidates: list[Condition], holds: dict[Condition, np.ndarray], rows: np.ndarray, low: np.ndarray) -> Rule:
    rule: list[Condition] = []
    now = rows
    while len(rule) < MAX_CONDITIONS:
        p, n = (now & low).sum(), (now & ~low).sum()
        if not p or not n:
            break
        base, best, gain = np.log2(p / (p + n)), None, 0.0
        for condition in candidates:
            met = now & holds[condition]
            q = (met & low).sum()
            if q >= LEAST_COVERED:
                value = q * (np.log2(q / met.sum()) - base)
                if value > gain + 1e-9:
                    best, gain = condition, value
        if best is None:
            break
        rule.append(best)
        now = now & holds[best]
    return tuple(rule)


def _prune(rule: Rule, holds: dict[Condition, np.ndarray], rows: np.ndarray, low: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the highest precision on the pruning rows."""

    def worth(part: Rule) -> float:
        met = rows & _meets(part, holds, len(low))
        return ((met & low).sum() + 1) / (met.sum() + 2)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (round(worth(part), 3), -len(part)), default=())


def learned(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """The rules learned from the labelled documents that pass the base rules."""
    names = list(ratios())
    found = labelled(documents, labels, rows).collect()  # at most `rows` short rows
    table = {name: np.array([row[name] for row in found], float) for name in names}
    low = np.array([row["low"] for row in found], bool)
    grow = np.array([row["draw"] % 3 != 0 for row in found], bool)
    return learn(table, low, grow)


def verdicts(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents with features, base_failed, rule (the text of the first that matches) and kept."""
    found = with_features(documents.drop("rule", "kept"))
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        met = F.lit(True)
        for condition in rule:
            met = met & condition.column()
        first = F.when(met, " and ".join(map(str, rule))).otherwise(first)
    found = found.withColumn("rule", first)
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    found = verdicts(documents.select("doc_id", "text"), learned(documents, labels))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the learned list, with their own columns."""
    judged = documents.select(F.struct(*documents.columns).alias("whole"), "text")
    return verdicts(judged, learned(documents, labels)).where("kept").select("whole.*")
