"""Keyed merges of repeated collection rounds. All are set-based: no row loops, no collected id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.text import normalized_text
from assetlens.operators.quality import names_where, terminal


def nonempty(c) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull() if isinstance(c, str) else F.nullif(c.cast("string"), F.lit("")).isNotNull()


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the greatest seq of each key; partial aggregation, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*").select(*df.columns)


def merge_prefer_nonempty(master: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Checkpoint values win where they are not empty; its new columns are added; master's rows stay."""
    cp = checkpoint.select(key, *[F.col(c).alias(f"_c_{c}") for c in checkpoint.columns if c != key])
    j = master.join(cp, key, "left")
    own = [F.when(nonempty(f"_c_{c}"), F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) if c != key and c in checkpoint.columns else F.col(c) for c in master.columns]
    return j.select(*own, *[F.col(f"_c_{c}").alias(c) for c in checkpoint.columns if c not in master.columns])


def overlay(master: DataFrame, checkpoint: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced by the checkpoint's without condition: null where it has null or no row."""
    cp = checkpoint.select(key, *[F.col(c).alias(f"_c_{c}") for c in columns])
    return master.join(cp, key, "left").select(*[F.col(f"_c_{c}").alias(c) if c in columns else F.col(c) for c in master.columns])


def overlay_changes(master: DataFrame, checkpoint: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column and changed: rows whose normalised text an overlay changes."""
    cp = checkpoint.select(key, *[F.col(c).alias(f"_c_{c}") for c in columns])
    one = master.join(cp, key, "left").agg(*[F.sum((normalized_text(c) != normalized_text(f"_c_{c}")).cast("int")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns])).alias("x")).select("x.*")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str, latest: list[str]) -> DataFrame:
    """old with new records applied in the order of seq (all greater than old's).

    Columns in `latest` take the last record's value, null included; others its last non-empty value. Unknown keys are
    inserted, columns united. Applying the same records again changes nothing.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    aggs = []
    for c in [c for c in both.columns if c not in (key, seq)]:
        if c in latest:
            aggs.append(F.max_by(F.struct(c), F.col(seq)).getField(c).alias(c))
        else:
            aggs.append(F.max_by(F.struct(c), F.when(nonempty(c), F.col(seq))).getField(c).alias(c))
    return both.groupBy(key).agg(F.max(seq).alias(seq), *aggs).select(*both.columns)


def pending(master: DataFrame, checkpoint: DataFrame, key: str, status: str, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Master rows whose key has no terminal status, in order, from an offset."""
    left = master.join(checkpoint.where(terminal(status)).select(key).distinct(), key, "left_anti").orderBy(order)
    left = left.offset(offset) if offset else left
    return left.limit(limit) if limit is not None else left


def best_attempt(attempts: DataFrame, key: str, attempt: str, issues: str, score: str) -> DataFrame:
    """Of each key the earliest attempt without issues, else the one with the highest score, the earliest among equals."""
    rest = F.struct(*[c for c in attempts.columns if c != key])
    clean = F.size(issues) == 0
    order = F.struct(clean.cast("int").alias("c"), F.when(clean, F.lit(0)).otherwise(F.col(score)).alias("s"), (-F.col(attempt)).alias("a"))
    return attempts.groupBy(key).agg(F.max_by(rest, order).alias("_r")).select(key, "_r.*").select(*attempts.columns)


def selective_update(old: DataFrame, new: DataFrame, key: str, formats: str, fields: str, scalars: list[str], suspicious) -> DataFrame:
    """Old and new records of a key made one: formats and fields only if better, scalars only into blanks; changed lists what changed.

    formats and fields are arrays; suspicious(column) tells whether a field list looks wrong.
    """
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in (formats, fields, *scalars)])
    j = old.join(n, key)
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    f, g = f"_n_{formats}", f"_n_{fields}"
    more_formats = (size(f) > 0) & (size(f) > size(formats))
    cured = F.coalesce(suspicious(fields), F.lit(False)) & ~F.coalesce(suspicious(g), F.lit(False))
    better_fields = (size(g) > 0) & ((size(fields) == 0) | cured | (size(g) > size(fields)))
    fills = {c: (normalized_text(c) == "") & (normalized_text(f"_n_{c}") != "") for c in scalars}
    changed = names_where({formats: more_formats, fields: better_fields, **fills})
    out = {formats: F.when(more_formats, F.col(f)).otherwise(F.col(formats)), fields: F.when(better_fields, F.col(g)).otherwise(F.col(fields))}
    out |= {c: F.when(fills[c], F.col(f"_n_{c}")).otherwise(F.col(c)) for c in scalars}
    return j.withColumn("changed", changed).withColumns(out).drop(*[c for c in j.columns if c.startswith("_n_")])


def full_update(new: DataFrame, key: str, asset_id) -> DataFrame:
    """The new record as it is, under the id that it was collected for."""
    return new.withColumn(key, asset_id)


def with_row_no(df: DataFrame, master: DataFrame, key: str, order: str, out: str = "row_no") -> DataFrame:
    """df with the place (1..n) of each key in master's order; null where master has no such key. Of a key that master has twice the last place counts."""
    from assetlens.operators.rank import in_order

    places = in_order(master.select(key, order), F.asc(order)).groupBy(F.col(key).alias("_k")).agg(F.max("_no").alias(out))
    return df.join(places, F.col(key) == F.col("_k"), "left").drop("_k")


def done_difference(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct ids that aren't among the done ones."""
    return ids.select(key).distinct().join(done.select(key), key, "left_anti")


def recollect_action(old_status: str, new_status: str, changed: Column, error: str) -> Column:
    """What a recollection does with a record."""
    o, n = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (old_status, new_status))
    failed = F.coalesce(F.trim(F.col(error)) != "", F.lit(False)) & ~n.isin("success", "unavailable")
    return F.when(failed, "failed").when((o == "success") & (n != "success"), "skip_success_regression").when((o != "success") & (n == "success"), "upsert_recovered_success").when((n == "success") & changed, "upsert_improved_success").when(n == "success", "checked_no_improvement").otherwise(F.concat(F.lit("upsert_"), n))


def residual(master: DataFrame, latest: DataFrame, key: str, issues) -> DataFrame:
    """Master rows with the latest record and its issues, where there are any. issues: a function of the joined frame."""
    j = master.join(latest, key, "left")
    return j.withColumn("residual_issues", issues(j)).where(F.size("residual_issues") > 0)


def attach_unique(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that fails when other has a key twice, instead of multiplying rows."""
    checked = other.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in other.columns if c != key])
    checked = checked.withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("key occurs more than once: "), F.col(key).cast("string")))))
    return df.join(checked.drop("_n"), key, "left")


#: Characters of the longest gram that blocks and names are joined on, and about how many rows of one gram, of either side, meet in one cell of the join.
GRAM, CELL = 6, 1_000


def name_hits(blocks: DataFrame, names: DataFrame, block: str, name: str, most: int = 300) -> DataFrame:
    """Distinct block and name where the block contains the name, whatever stands beside it. Null and empty names are in no block.

    Up to `most` names are broadcast. More are joined with the blocks on a gram (see _shared_gram); either way contains() decides.
    """
    b = blocks.select(F.col(block).alias("_b")).where("_b is not null").distinct()
    n = names.select(F.col(name).alias("_n")).where("_n <> ''").distinct()
    few = n.limit(most + 1).count() <= most
    hits = b.join(F.broadcast(n), F.contains("_b", "_n")) if few else _shared_gram(b, n)
    return hits.select(F.col("_b").alias(block), F.col("_n").alias(name))


def name_in_text(blocks: DataFrame, names: DataFrame, block: str, name: str, most: int = 300) -> DataFrame:
    """Blocks that hold exactly one name, with it. The answer doesn't depend on `most` (see name_hits)."""
    hits = name_hits(blocks, names, block, name, most)
    one = hits.groupBy(block).agg(F.min(name).alias(name), F.max(name).alias("_hi")).where(F.col(name) == F.col("_hi"))
    return one.drop("_hi")


def _grams(c: str, lengths) -> Column:
    """The distinct runs of so many characters; the characters are split once per row."""
    runs = lambda x, k: F.when(F.size(x) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), ""))).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.array(F.split(c, "")), lambda x: F.array_distinct(F.concat(*[runs(x, F.lit(k)) for k in lengths])))
    return F.get(every, F.lit(0))


def _shared_gram(b: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs of _b and _n where _b contains _n, by a join on that gram of the name which the fewest blocks have.

    Grams have GRAM characters, or all of a shorter name. A gram that many blocks or names have is dealt out in cells. The joins
    are shuffled whatever Spark expects: it takes exploded grams for no more than the texts, and those for their files' bytes.
    """
    size = F.least(F.char_length("_n"), F.lit(GRAM))
    lengths = sorted(r[0] for r in n.select(size.alias("k")).distinct().collect())  # at most GRAM numbers
    own = F.when(F.char_length("_n") >= GRAM, _grams("_n", [GRAM])).otherwise(F.array("_n"))
    mine = n.select("_n", F.explode(own).alias("_g"))
    theirs = b.select(F.xxhash64("_b").alias("_id"), F.explode(_grams("_b", lengths)).alias("_g"))
    in_blocks = theirs.groupBy("_g").agg(F.count(F.lit(1)).alias("_nb"))
    chosen = mine.join(in_blocks.hint("merge"), "_g").groupBy("_n").agg(F.min_by(F.struct("_g", "_nb"), F.struct("_nb", "_g")).alias("x")).select("_n", "x._g", "x._nb")
    cells = chosen.groupBy("_g").agg(F.ceil(F.max("_nb") / CELL).cast("int").alias("_s"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_t"))
    deal = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = theirs.join(cells.hint("merge"), "_g").select("_g", "_id", F.pmod("_id", "_s").cast("int").alias("_i"), deal("_t").alias("_j"))
    right = chosen.join(cells.hint("merge"), "_g").select("_g", "_n", F.pmod(F.xxhash64("_n"), "_t").cast("int").alias("_j"), deal("_s").alias("_i"))
    pairs = left.join(right.hint("merge"), ["_g", "_i", "_j"]).select("_id", "_n")
    # ids may clash: each text of an id is looked at, and a pair stays only if the text contains the name
    return b.withColumn("_id", F.xxhash64("_b")).join(pairs.hint("merge"), "_id").where(F.contains("_b", "_n")).select("_b", "_n")


def strict_subset(new: str, old: str) -> Column:
    return (F.size(F.array_except(new, old)) == 0) & (F.size(F.array_distinct(new)) < F.size(F.array_distinct(old)))


def union_widened(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def retry_queue(df: DataFrame, key: str, core: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with an issue and the joined names of what is wrong with them."""
    from assetlens.functions.text import is_blank

    reasons = names_where({f"missing_{c}": is_blank(c) for c in core} | (extra or {}))
    return df.withColumn("retry_reason", F.array_join(reasons, ";")).where("retry_reason <> ''")
