"""Quality verdicts by decision lists that are learnt from labelled statistics, DataFrame functions only.

Each text becomes a row of statistics. Rules against bad documents are learnt by sequential covering: a rule grows
by the threshold condition with the highest information gain on two thirds of the labelled rows, loses
conditions from its end again while the other third says so, and takes the rows it covers out; the next rule
is learnt from the rest. Thresholds are boundaries of fixed cells, so a step of growth is one aggregate over the
labelled rows, of a size that depends on the number of cells only, and every labelled row counts.
The list is a chain of ``when`` expressions: Spark judges a document where it stands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"
SPAN = 8  # words of a window of the repeat count, a power of two
CELLS = 512  # cells of a statistic
PARTS = 3  # one in so many labelled rows prunes, the others grow
MOST_RULES, MOST_CONDITIONS = 12, 4
PRECISION = 0.75  # least share of bad documents among those a rule covers, in the rows that grow and in those that prune it
COVER = 3  # least number of bad documents that a rule covers

#: The statistics that rules may use, and how many cells one unit has. All are shares but the last three.
FEATURES: dict[str, int] = {
    "symbol_share": 512, "repeat_share": 512, "dup_line_share": 512, "capital_share": 512, "mark_share": 512, "digit_share": 512,
    "distinct_share": 512, "word_length": 16, "line_words": 4, "log_words": 16,
}


@dataclass(frozen=True)
class Condition:
    """``feature >= at`` or, if not ``above``, ``feature < at``."""

    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x >= F.lit(self.at) if self.above else x < F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.at:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, c: a & c.column(), rule, F.lit(True))


def accepts(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false where a rule covers the row, the first that does decides; else true."""
    return reduce(lambda out, rule: out.when(covers(rule), False), rules, F.when(F.lit(False), False)).otherwise(True)


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), the counts and the ``FEATURES`` of each text.

    Counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` with a word, ``n_dup_lines`` and ``n_repeat_words``, the words in
    windows of ``SPAN`` words that occur twice or more in the text; words and windows are compared by 64-bit hashes. A null text is
    empty: all its counts are 0, as are its shares. Columns of the same names are replaced. Nothing is shuffled; the
    work on a text is linear in its length but for a sort of its window hashes, where any repeat.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *FEATURES]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(*[F.col(c).alias(f"_tm_in_{c}") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("_tm_text"))
    rows = rows.withColumn("_tm_bare", F.trim("_tm_text", F.lit(WHITE)))
    words = F.when(F.col("_tm_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_tm_bare", GAP))
    lines = F.filter(F.split("_tm_text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(*[f"_tm_in_{c}" for c in kept], words.alias("_tm_words"), lines.alias("_tm_lines"))
    rows = rows.withColumns({"n_words": F.size("_tm_words").cast("long"), "_tm_solid": F.array_join("_tm_words", "")})
    rows = rows.withColumn("_tm_spans", F.transform("_tm_words", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("_tm_distinct", F.size(F.array_distinct("_tm_spans")).cast("long"))
    step = 1
    while step < SPAN:  # hashes of twice as many words, from each and the one that follows it
        pairs = F.zip_with(F.slice("_tm_spans", 1, F.greatest(F.size("_tm_spans") - step, F.lit(0))), F.slice("_tm_spans", step + 1, F.size("_tm_spans")), lambda a, b: F.xxhash64(a, b))
        rows, step = rows.withColumn("_tm_spans", pairs), 2 * step
    repeats = F.size(F.array_distinct("_tm_spans")) < F.size("_tm_spans")
    ordered = F.array_sort(F.transform("_tm_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_tm_order", F.when(repeats, ordered)).drop("_tm_spans")
    twin = lambda x, k: F.when((F.get("_tm_order", k - 1)["h"] == x["h"]) | (F.get("_tm_order", k + 1)["h"] == x["h"]), x["i"])
    starts = F.array_sort(F.array_compact(F.transform("_tm_order", twin)))
    rows = rows.withColumn("_tm_starts", starts).drop("_tm_order")
    added = F.transform("_tm_starts", lambda s, k: F.least(F.coalesce(F.get("_tm_starts", k + 1) - s, F.lit(SPAN)), F.lit(SPAN)))
    covered = F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)
    # what is counted below has no a to z in it, so the counts read little of the text
    rows = rows.withColumn("_tm_rest", F.regexp_replace("_tm_solid", "[a-z]+", ""))
    count = lambda pattern: (F.length("_tm_rest") - F.length(F.regexp_replace("_tm_rest", pattern, ""))).cast("long")
    rows = rows.select(
        *[f"_tm_in_{c}" for c in kept],
        "n_words",
        F.length("_tm_solid").cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        F.size("_tm_lines").cast("long").alias("n_lines"),
        (F.size("_tm_lines") - F.size(F.array_distinct("_tm_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        count(r"\p{Lu}+").alias("_tm_capitals"),
        count(r"[.,;:!?]+").alias("_tm_marks"),
        count(r"[0-9]+").alias("_tm_digits"),
        "_tm_distinct",
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    features = {
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "capital_share": share("_tm_capitals", "word_chars"), "mark_share": share("_tm_marks", "word_chars"), "digit_share": share("_tm_digits", "word_chars"),
        "distinct_share": share("_tm_distinct", "n_words"), "word_length": share("word_chars", "n_words"), "line_words": share("n_words", "n_lines"),
        "log_words": F.log2(F.col("n_words") + 1.0),
    }
    names = [c for c in made if c not in FEATURES]
    return rows.select(*[F.col(f"_tm_in_{c}").alias(c) for c in kept], *names, *[x.alias(n) for n, x in features.items()])


def fails_base() -> Column:
    """Fewer than 20 words, or more than 30 in 100 in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bad: int = 0) -> list[Rule]:
    """Rules that cover documents labelled ``bad``, in order, from the statistics of labelled documents.

    Rows that fail the base rules, and labels that are null, of null ids or contradict each other, teach nothing; a repeated
    id counts once for each different row of statistics. Which rows prune is decided by a hash of the id. A rule stays only if ``PRECISION`` of the
    rows it covers are bad, in both parts, and ``COVER`` bad ones at least; without such a rule, and without labels of both
    kinds, the list is empty and accepts everything. All labelled rows count; the driver receives counts of cells.
    """
    keep = Scratch()
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high").select("id", (F.col("low") == bad).alias("bad"))
    rows = stats.where(~fails_base()).select(F.col(id_col).alias("id"), *FEATURES).distinct().join(marks, "id")
    rows = rows.withColumn("prunes", F.crc32(F.concat(F.lit("part "), F.col("id").cast("string")).cast("binary")) % PARTS == 0)
    rows = keep.stored(rows.select("bad", "prunes", *FEATURES), "labelled")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.where(reduce(lambda a, r: a & ~covers(r), rules, F.lit(True)))
        rule = _pruned(left, _grown(left.where("not prunes")))
        if not rule:
            break
        rules.append(rule)
    keep.drop(stats.sparkSession)
    return rules


def cell_counts(rows: DataFrame) -> dict[str, list[list[int]]]:
    """For each feature, the numbers of good and of bad rows in each of its cells, in one aggregate."""
    cells = [F.struct(F.lit(k).alias("feature"), F.least(F.floor(F.col(f) * unit), F.lit(CELLS - 1)).cast("int").alias("cell")) for k, (f, unit) in enumerate(FEATURES.items())]
    counts = rows.select("bad", F.explode(F.array(*cells)).alias("x")).groupBy("x.feature", "x.cell").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    out = {f: [[0, 0] for _ in range(CELLS)] for f in FEATURES}
    names = list(FEATURES)
    for r in counts.collect():  # at most one row for each cell of each feature
        out[names[r["feature"]]][r["cell"]] = [r["good"], r["bad"]]
    return out


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def best_condition(counts: dict[str, list[list[int]]]) -> tuple[Condition, int, int] | None:
    """The condition of the highest gain, with the bad and good rows it covers.

    Of conditions of one gain the first by feature, side and cell; where cells without rows follow, the threshold is the middle of the gap.
    """
    best, found = 1e-9, None
    for feature, cells in counts.items():
        good, bad = (sum(c[k] for c in cells) for k in (0, 1))
        if not bad:
            return None
        low_good = low_bad = 0
        for k in range(1, CELLS):
            low_good, low_bad = low_good + cells[k - 1][0], low_bad + cells[k - 1][1]
            for above, b, g in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                if (gain := _gain(b, g, bad, good)) > best:
                    best, found = gain, (feature, above, k, b, g)
    if not found:
        return None
    feature, above, k, b, g = found
    end = next((i for i in range(k, CELLS) if any(counts[feature][i])), k)
    return Condition(feature, above, (k + end) / 2 / FEATURES[feature]), b, g


def _grown(rows: DataFrame) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        found = best_condition(cell_counts(rows.where(covers(rule))))
        if not found:
            break
        condition, _, good = found
        rule = (*rule, condition)
        if not good:
            break
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The beginning of ``rule`` with the highest (bad - good) / (bad + good) in the rows that prune, the shortest of equals; nothing if it is not good enough."""
    if not rule:
        return ()
    sums = []
    for n in range(1, len(rule) + 1):
        for part in ("prunes", "not prunes"):
            for kind in ("bad", "not bad"):
                sums.append(F.count_if(covers(rule[:n]) & F.expr(part) & F.expr(kind)).alias(f"s{len(sums)}"))
    counts = list(rows.agg(*sums).first())
    best, out = None, ()
    for n in range(1, len(rule) + 1):
        bad, good, own_bad, own_good = counts[4 * n - 4 : 4 * n]
        value = (bad - good) / (bad + good) if bad + good else -1.0
        if best is None or value > best:
            whole = own_bad >= PRECISION * (own_bad + own_good) and bad >= PRECISION * (bad + good) and bad + own_bad >= COVER
            best, out = value, rule[:n] if whole else ()
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``: false where the base rules fail, else what the list says."""
    return stats.withColumns({"base_failed": fails_base(), "kept": ~fails_base() & accepts(rules)})
