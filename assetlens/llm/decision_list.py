"""Quality rules: fixed base rules and a learned decision list, with DataFrame functions only.

text_stats() computes the statistics of every whole text in one projection, without a shuffle: the repeated 3-word
windows of a text come from sorting its own hashes. learn_rules() is sequential covering over a
bounded sample of labelled statistics: a rule is a conjunction of thresholds, grown condition by condition on two
thirds of the sample and pruned on the rest, where it must cover a row; the rows it covers leave, and the next rule is learned. Each step asks
Spark for the label counts by statistic and bin. as_column() turns the list into one ordered CASE expression.

Edge cases: a null text counts as empty; texts without words have zero statistics and fail the base rule; an empty or
unlabelled training table, or one with one kind of label good only, gives an empty list, which keeps everything that passes the base rule; rows with equal ids are
each judged, and equal rows count once to learn; other columns stay as they are in judge(), and clashing names of statistics are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.llm._shared import SPACE

#: Most labelled rows that the learner looks at, taken by the order of a hash of their ids.
SAMPLE = 20_000
#: The statistics that conditions may test.
MEASURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "lines_per_word")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.measure) > self.cut if self.above else F.col(self.measure) <= self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    reject: bool
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and MEASURES."""
    made = {"_t", "_w", "_h", "_g", "_s", "_d", "_p", "_l", "_c", "_m", "_n"}
    keep = [c for c in docs.columns if c != text and c not in made and c not in MEASURES]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"),
            "_c": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")),
            "_m": F.length(F.regexp_replace("_t", r"[^!?]+", "")),
            "_n": F.size("_l"),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_t", "_w", "_l")
    n = F.size("_h")
    # _g: the hash of each window of three words; _s: the same, sorted; _d: the hashes found twice or more
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))
    d = d.withColumn("_g", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    d = d.withColumn("_s", F.sort_array("_g"))
    d = d.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))).drop("_s")
    # _p: the windows' places. A short list of hashes is looked up; a long one is matched by sorting (hash, place) pairs
    none = F.array().cast("array<int>")
    looked_up = F.filter(F.transform("_g", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda x: x.isNotNull())
    d = d.withColumn("_p", F.when(F.size("_d") == 0, none).when(F.size("_d") <= 32, looked_up).otherwise(_places_by_sorting("_g"))).drop("_g", "_d")
    k = F.size("_p")
    later = F.when(k > 1, F.slice("_p", 2, k - 1)).otherwise(none)
    gaps = F.zip_with("_p", later, lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p")
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("_n", F.lit(1))
    return d.withColumns(
        {
            "words": F.col("n_words").cast("double"),
            "word_length": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("_c") / chars,
            "mark_share": F.col("_m") / chars,
            "lines_per_word": lines / words,
        }
    ).drop("_c", "_m", "_n")


def _places_by_sorting(hashes: str) -> Column:
    """Places of the hashes that occur twice or more, in order: equal ones are neighbours among the sorted pairs."""
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    m = F.size(hashes)
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    ahead = F.when(m > 1, F.slice(pairs, 2, m - 1)).otherwise(none)
    behind = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), F.slice(pairs, 1, F.greatest(m - 1, F.lit(0))))
    near = F.zip_with(pairs, behind, lambda x, y: F.struct(x["h"].alias("h"), x["p"].alias("p"), x["h"].eqNullSafe(y["h"]).alias("e")))
    found = F.zip_with(near, ahead, lambda x, y: F.when(x["e"] | x["h"].eqNullSafe(y["h"]), x["p"]))
    return F.sort_array(F.filter(found, lambda x: x.isNotNull()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) that are in a bounded sample of labels, with good (1 or 0). Equal rows count once, and an id of many rows counts with as many as the bound leaves."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.join(F.broadcast(chosen), "doc_id").withColumn("_row", F.xxhash64("doc_id", "text")).dropDuplicates(["_row"])
    keys = rows.select("_row").orderBy("_row").limit(sample)
    return rows.join(F.broadcast(keys), "_row").drop("_row")


def learn_rules(stats: DataFrame, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_rows: int = 5, precision: float = 0.95) -> list[Rule]:
    """Rules that reject, in order. stats: MEASURES, good and doc_id; a bounded sample, kept in memory."""
    stats = stats.select("doc_id", "good", *MEASURES).where(F.col("good").isNotNull()).persist()
    rows = None
    try:
        # exact, so that the rules don't hang on the order of rows; the sample is bounded
        cuts = stats.agg(*[F.percentile(m, [i / bins for i in range(1, bins)]).alias(m) for m in MEASURES]).first()
        edges = {m: sorted(set(cuts[m] or [])) for m in MEASURES}
        if not any(edges.values()):
            return []
        bins_of = [F.struct(F.lit(i).alias("m"), F.size(F.filter(F.lit(edges[m]).cast("array<double>"), _below(m))).alias("bin")) for i, m in enumerate(MEASURES) if edges[m]]
        rows = stats.withColumns({"grow": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2, "bins": F.array(*bins_of)}).coalesce(8).persist()
        rules: list[Rule] = []
        left = F.lit(True)
        for _ in range(max_rules):
            rule = _grown(rows.where(left & F.col("grow")), edges, max_conditions, min_rows, precision)
            rule = rule and _pruned(rows.where(left & ~F.col("grow")), rule, precision)
            if rule is None:
                break
            rules.append(rule)
            left = left & ~rule.column()
        return rules
    finally:
        stats.unpersist()
        if rows is not None:
            rows.unpersist()


def _below(measure: str):
    return lambda edge: edge < F.col(measure)


def _counts(rows: DataFrame) -> dict:
    """For each measure, the (bad, good) counts by bin."""
    got = rows.select("good", F.explode("bins").alias("x")).groupBy("x.m", "x.bin").agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good"))
    out: dict = {}
    for r in got.collect():  # at most measures x bins rows
        out.setdefault(MEASURES[r["m"]], {})[r["bin"]] = (r["bad"], r["good"])
    return out


def _grown(rows: DataFrame, edges: dict, max_conditions: int, min_rows: int, precision: float) -> Rule | None:
    conditions: list[Condition] = []
    best = None
    for _ in range(max_conditions):
        here = rows
        for c in conditions:
            here = here.where(c.column())
        counts, found = _counts(here), None
        for m, by_bin in counts.items():
            for i, cut in enumerate(edges[m]):
                for above in (True, False):
                    part = [v for b, v in by_bin.items() if (b > i) == above]
                    bad, good = sum(v[0] for v in part), sum(v[1] for v in part)
                    if bad >= min_rows:
                        value = (bad + 1) / (bad + good + 2)
                        if found is None or (value * bad**0.1, bad) > found[0]:
                            found = ((value * bad**0.1, bad), Condition(m, above, cut), value, bad / (bad + good))
        if found is None or (best is not None and found[2] <= best):
            break
        conditions.append(found[1])
        best = found[2]
        if found[3] >= 0.999:
            break
    return Rule(tuple(conditions), True, best) if conditions and best >= precision * 0.9 else None


def _pruned(rows: DataFrame, rule: Rule, precision: float) -> Rule | None:
    """The shortest leading part of the rule that is about as pure on the rows held back; None if even the whole isn't pure."""
    parts = [Rule(rule.conditions[:k], True, 0.0) for k in range(1, len(rule.conditions) + 1)]
    got = rows.agg(*[x for k, p in enumerate(parts) for x in (F.count(F.when(p.column() & (F.col("good") == 0), 1)).alias(f"b{k}"), F.count(F.when(p.column(), 1)).alias(f"n{k}"))]).first()
    purity = [(got[f"b{k}"] + 1) / (got[f"n{k}"] + 1) if got[f"n{k}"] else 0.0 for k in range(len(parts))]  # a part that covers no row held back has no evidence
    if max(purity) < precision:
        return None
    k = next(k for k, v in enumerate(purity) if v >= max(precision, max(purity) - 0.01))
    return Rule(parts[k].conditions, True, float(purity[k]))


def as_column(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, 0 for none: an ordered CASE expression."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), i) if out is None else out.when(r.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def kept(rules: list[Rule]) -> Column:
    """Whether a row passes the base rule and the list.

    The partition's number, which is never negative, makes the expression one that Spark won't copy into the places
    below it: a filter on it is evaluated on the finished statistics, not once more for each word of a text.
    """
    return ~base_failed() & (as_column(rules) == 0) & (F.spark_partition_id() >= 0)


def learned(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> list[Rule]:
    return learn_rules(text_stats(labelled_sample(docs.select("doc_id", "text"), labels, label, sample)))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs' columns but text, the statistics, base_failed, rule (the first that fires, or 0) and kept."""
    rules = learned(docs, labels, label, sample)
    return text_stats(docs).withColumns({"base_failed": base_failed(), "rule": as_column(rules), "kept": kept(rules)})


def keep_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, unchanged. The text travels beside its statistics: no join, no shuffle."""
    rules = learned(docs, labels, label, sample)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return text_stats(row).withColumn("kept", kept(rules)).where("kept").select("row.*")
