"""Learned decision lists over text statistics.

The statistics are built-in column expressions: the words of a text become an
array, three-word windows are hashed to 64 bits, and windows found twice are
seen in the sorted hashes, so that a text costs n log n in its own length and
nothing is exploded or shuffled. (Two different windows of one text share a
64-bit hash with a chance under 1e-11 at 20,000 words.)

The rules are learned on the driver from the statistics of a bounded number of
labelled rows (``MAX_LABELLED``, those with the least md5 of their id), by
sequential covering: a conjunction of thresholds is grown by information gain
on two thirds of the rows, pruned from its end on the other third, kept if it
is precise there, and what it covers is taken away. The list becomes one
ordered ``CASE`` expression.

Defined cases: a null text has no words; a label that is null is no label; no
labels, or labels of one class only, give the empty list, which keeps all; an
empty table gives no rows; clashing columns of the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import WORD, least_hashed, read_table, word_list

#: Labelled rows that the list is learned from, at most.
MAX_LABELLED = 20_000
#: Least precision on the pruning rows, least rows that a rule covers, most rules and conditions.
PRECISION, COVER, MAX_RULES, MAX_CONDITIONS = 0.9, 8, 12, 4
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may test, as SQL over the statistics; ratios are 0 for texts without words.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_chars": "coalesce(try_divide(word_chars, n_words), 0D)",
    "symbol_share": "coalesce(try_divide(n_symbols, word_chars), 0D)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_words), 0D)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
}


def text_statistics(df: DataFrame) -> DataFrame:
    """Adds the five statistics of ``text``; drops ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for blank in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(blank), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    out = df.drop(*STATS).withColumns(
        {
            "_w": word_list(F.col("text")),
            "_lines": lines,
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    ).drop("text")
    windows = "if(size(_w) < 3, array(), transform(sequence(0, greatest(size(_w) - 3, 0)), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))))"
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_g": F.expr(windows),
        }
    ).drop("_w", "_lines")
    found_twice = F.size(F.array_distinct("_g")) < F.size("_g")
    out = out.withColumn("_s", F.when(found_twice, F.expr("array_sort(transform(_g, (h, i) -> struct(h as h, i as i)))"))).drop("_g")
    # a window's neighbours in the sorted hashes tell whether it is found again
    again = "transform(filter(_s, (x, j) -> coalesce(get(_s, j + 1).h = x.h, false) or coalesce(j > 0 and get(_s, j - 1).h = x.h, false)), x -> array(x.i, x.i + 1, x.i + 2))"
    repeat = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.expr(again)))))
    return out.withColumn("n_repeat_words", repeat.cast("long")).drop("_s")


def _entropy_gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_list(rows: list[tuple[list[float], int]]) -> list[list[tuple[int, str, float]]]:
    """Ordered rules for class 0 of (features, label) rows; a rule is a list of (feature, '<=' or '>=', threshold)."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[tuple[int, str, float]]] = []

    def holds(rule, x):
        return all(x[f] <= t if op == "<=" else x[f] >= t for f, op, t in rule)

    def split(part):
        return sum(1 for _, y in part if y == 0), sum(1 for _, y in part if y != 0)

    def best_condition(part):
        """One pass over each feature's sorted values gives the counts for every threshold."""
        p0, n0 = split(part)
        best = (0.0, None)
        for f in range(len(part[0][0])):
            values = sorted((x[f], y) for x, y in part)
            p = n = 0
            for k, (v, y) in enumerate(values):
                p, n = p + (y == 0), n + (y != 0)
                if k + 1 < len(values) and values[k + 1][0] > v:
                    middle = (v + values[k + 1][0]) / 2
                    best = max(best, (_entropy_gain(p0, n0, p, n), (f, "<=", middle)), (_entropy_gain(p0, n0, p0 - p, n0 - n), (f, ">=", middle)), key=lambda b: b[0])
        return best[1]

    def worth(rule):
        p, n = split([r for r in prune if holds(rule, r[0])])
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < MAX_RULES and split(grow)[0] >= COVER and split(prune)[0]:
        rule, part = [], grow
        while split(part)[1] and len(rule) < MAX_CONDITIONS and (condition := best_condition(part)):
            rule.append(condition)
            part = [r for r in part if holds([condition], r[0])]
        for length in range(len(rule) - 1, 0, -1):
            if worth(rule[:length]) >= worth(rule):
                rule = rule[:length]
        p, n = split([r for r in prune if holds(rule, r[0])])
        if not rule or p + n < COVER / 2 or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not holds(rule, r[0])], [r for r in prune if not holds(rule, r[0])]
    return rules


def list_expression(rules: list[list[tuple[int, str, float]]]) -> Column:
    """The list as one ordered expression: false where a rule fires, else true."""
    names = list(FEATURES)
    cases = "".join(
        " when " + " and ".join(f"{FEATURES[names[f]]} {op} {t!r}D" for f, op, t in rule) + " then false" for rule in rules
    )
    return F.expr(f"case{cases} else true end" if rules else "true")


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[tuple[int, str, float]]]:
    """The list for (doc_id, text) and (doc_id, quality)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = least_hashed(known, max_labelled, F.col("doc_id"))  # at most max_labelled pairs of numbers are broadcast
    stats = text_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    numbers = stats.select(F.md5(F.col("doc_id").cast("string")).alias("_h"), "quality", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    # ids may be repeated, so that rows are bounded as well; equal rows are alike
    found = numbers.orderBy("_h", *FEATURES).limit(max_labelled).collect()
    return learn_list([([float(v) for v in r[2:]], int(r[1])) for r in found])


def apply_list(df: DataFrame, rules: list[list[tuple[int, str, float]]]) -> DataFrame:
    """Adds the statistics, ``base_failed`` and ``kept`` to (..., text); drops ``text``."""
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return text_statistics(df.drop("base_failed", "kept")).withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(list_expression(rules))
    )


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, read_table(spark, sf_dir, "labels"))
    return apply_list(docs, rules).select("doc_id", *STATS, "base_failed", "kept")
