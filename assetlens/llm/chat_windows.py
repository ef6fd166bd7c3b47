"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts ``&``, ``<``, ``[`` and ``|`` are
written as entities, so that no control string can occur inside a turn and unescaping gives the text back.

Windows: what the conversation's system turn (its first turn, if its role is ``system``) leaves of the budget is halved; that is
a share. The running token sum of the other turns is cut into shares. A turn opens a new span
when it crosses a share's border, when it alone is longer than a share, or when the turn before it was. Spans are
turn-aligned, cover each turn once, and hold no more than two shares unless one turn does. Each window starts with
the system turn, then up to ``history`` turns before the span as far as the budget allows, then the span. So a window holds no more than the budget,
but for one case: a turn that alone is longer than what the system turn leaves makes a window with the system turn, and neither is cut.
Repeated turns never carry loss; of the span's own turns the assistant's texts do.

Turns are dealt out by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks, and so are many rows of one turn; their places then
follow from the order inside a range and from a table of one row per range and conversation, which also carries running sums and open spans over the borders.
Which turn goes to which window (its own span's, and those of the next spans as history) is worked out without texts; then texts are joined to it. The windows don't depend on the ranges.
Only read_back() gathers a conversation, as its digest is sequential.

Edge cases: null text or role is empty; an empty table gives no rows; rows with the same conv_id and turn keep an
order by role and text, and those that agree in the text's first characters too lie in one range; repeated rows are separate turns; a null turn sorts first; a null conv_id is one more
conversation; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlens.llm._shared import SPACE
from assetlens.scratch import Scratch

BOT, EOT = "<|im_start|>", "<|im_end|>\n"
#: Escapes in the order in which they are applied; fixed values of this template.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))


def escape(text: Column) -> Column:
    for char, entity in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for char, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


#: Characters of a text that ranges may part.
PREFIX = 64
#: A conversation's key without nulls, and that of its turns in one range.
KEY = ("k_conv", "k_none")
BLOCK = (*KEY, "block")


def _part(no, role, text, tokens):
    head = F.concat(F.lit(BOT), escape(role), F.lit("\n"))
    body = escape(text)
    return F.struct(no.cast("long").alias("no"), F.concat(head, body, F.lit(EOT)).alias("piece"), F.length(head).alias("lead"), F.length(body).alias("size"), (F.length(head) + F.length(body) + len(EOT)).alias("total"), (role == "assistant").alias("target"), tokens.alias("tokens"))


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns in order: seq grows with conversation, turn, role and text; block is the range."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(f"[^{SPACE}]+")).cast("long") + 1)
    t = t.withColumns({KEY[0]: F.coalesce(F.col("conv_id").cast("string"), F.lit("")), KEY[1]: F.col("conv_id").isNull()})
    t = t.repartitionByRange(*KEY, "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions(*KEY, "turn", "role", "text")
    return scratch.written(t.withColumns({"seq": F.monotonically_increasing_id(), "block": F.spark_partition_id()}), "turns")


def _spans(placed: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """KEY, seq, no, opens and span of each turn, with head and system (seq and tokens of the system turn, 0 without one)."""
    slim = placed.select(*BLOCK, "seq", "tokens", (F.col("role") == "system").alias("sys"))
    per = slim.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("c"), F.sum("tokens").alias("s"), F.min("seq").alias("lo"), F.max_by("tokens", "seq").alias("last"), F.min_by(F.struct("sys", "tokens", "seq"), "seq").alias("h"))
    blocks = W.partitionBy(*KEY).orderBy("block")
    earlier = blocks.rowsBetween(W.unboundedPreceding, -1)
    head = F.first("h").over(blocks.rowsBetween(W.unboundedPreceding, 0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = per.select(*BLOCK, "lo", zero(F.sum("c").over(earlier)).alias("turns_before"), zero(F.sum("s").over(earlier)).alias("tokens_before"), zero(F.lag("last").over(blocks)).alias("last_before"), head.alias("h"))
    per = per.withColumns({"head": F.col("h.seq"), "system": F.when(F.col("h.sys"), F.col("h.tokens")).otherwise(0)}).drop("h")
    t = slim.drop("sys").join(per, list(BLOCK))
    order = W.partitionBy(*BLOCK).orderBy("seq")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("no", F.col("turns_before") + F.col("seq") - F.col("lo") + 1)
    t = t.withColumns({"counted": F.when((F.col("no") == 1) & (F.col("system") > 0), 0).otherwise(F.col("tokens")), "share": F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("system")) / 2))})
    # the head is in the first block; after it the sum goes on without the system turn
    t = t.withColumn("end", F.sum("counted").over(upto) + F.when(F.col("turns_before") > 0, F.col("tokens_before") - F.col("system")).otherwise(0))
    border = F.floor((F.col("end") - 1) / F.col("share")) != F.floor((F.col("end") - F.col("counted") - 1) / F.col("share"))
    over_border = F.when((F.col("turns_before") == 1) & (F.col("system") > 0), 0).otherwise(F.col("last_before"))
    before = F.coalesce(F.lag("counted", 1).over(order), over_border)
    opens = (border & (F.col("end") > F.col("counted"))) | (F.col("counted") > F.col("share")) | (before > F.col("share"))
    after_system = (F.col("no") == 2) & (F.col("system") > 0)
    t = t.withColumn("opens", (F.col("no") == 1) | (opens & ~after_system))
    t = scratch.written(t.withColumn("own", F.max(F.when(F.col("opens"), F.col("no"))).over(upto)).select(*BLOCK, "seq", "no", "opens", "own", "head", "system"), "opens")
    carried = t.groupBy(*BLOCK).agg(F.max("own").alias("o")).select(*BLOCK, F.max("o").over(earlier).alias("carried"))
    return scratch.written(t.join(carried, list(BLOCK)).select(*KEY, "seq", "no", "opens", F.coalesce("own", "carried").alias("span"), "head", "system"), "spans")


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """One row per window: conv_id, window_no (the place of its span's first turn), n_repeated, n_tokens, formatted, loss_spans.

    turns: conv_id, turn, role, text. A token is a word here, and one more for the turn. loss_spans: (start, length) in characters of formatted.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    placed = _placed(turns, scratch)
    t = _spans(placed, budget, scratch)
    # kind 0: the system turn ahead of a later span, 1: turns before a span, 2: the span's own
    own = t.select(*KEY, "span", F.lit(2).alias("kind"), "no", "seq")
    later = t.where("opens and no > 1")
    fixed = later.where("system > 0").select(*KEY, "span", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("no"), F.col("head").alias("seq"))
    member = own.unionByName(fixed)
    if history:
        back = later.select(*KEY, "span", "system", F.explode(F.transform(F.sequence(F.lit(1), F.lit(history)), lambda d: F.col("no") - d)).alias("no")).where("no > 1 or (no = 1 and system = 0)")
        member = member.unionByName(back.join(t.select(*KEY, "no", "seq"), [*KEY, "no"]).select(*KEY, "span", F.lit(1).alias("kind"), "no", "seq"))
    member = scratch.written(member, "members")
    part = _part(F.col("no"), F.col("role"), F.col("text"), F.col("tokens"))
    g = member.join(placed.select("seq", "conv_id", "role", "text", "tokens"), "seq").select(*KEY, "span", "kind", "conv_id", part.alias("part"))
    kind = g.schema["part"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    g = g.groupBy(*KEY, "span").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("kind", "part"))).alias("x"))
    of = lambda k: F.transform(F.filter("x", lambda x: x["kind"] == k), lambda x: x["part"])
    g = g.select("conv_id", "span", of(0).alias("fixed"), of(1).alias("recent"), of(2).alias("own"))
    # history gives way where it doesn't fit the budget: the newest turns that fit stay
    spent = F.aggregate(F.concat("fixed", "own"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    g = g.withColumn("room", F.lit(budget).cast("long") - spent)
    g = g.withColumn("left", F.aggregate(F.reverse("recent"), F.struct(F.col("room").alias("room"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct((a["room"] - x["tokens"]).alias("room"), (a["n"] + (a["go"] & (a["room"] >= x["tokens"])).cast("int")).alias("n"), (a["go"] & (a["room"] >= x["tokens"])).alias("go"))))
    g = g.withColumn("repeated", F.concat("fixed", F.slice("recent", F.greatest(F.lit(1), F.size("recent") - F.col("left.n") + 1), F.col("left.n"))))
    g = g.withColumn("all", F.concat("repeated", "own")).withColumn("n_repeated", F.size("repeated"))
    # the place of each turn in the output, from a running sum of lengths
    spans = F.aggregate(
        F.transform("all", lambda x, i: F.struct((x["target"] & (i >= F.col("n_repeated"))).alias("target"), x["lead"].alias("lead"), x["size"].alias("size"), x["total"].alias("total"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["total"]).alias("at"),
            F.when(x["target"], F.concat(a["out"], F.array(F.struct((a["at"] + x["lead"]).alias("start"), x["size"].alias("length"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return g.select(
        "conv_id",
        F.col("span").alias("window_no"),
        "n_repeated",
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """From the windows alone: per conversation its turns' digest and that of all text under the loss mask."""
    turns = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    own = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.lit(0), F.size(turns) - F.col("n_repeated")))
    plain = F.transform(own, lambda x: unescape(F.substr(x, F.lit(len(BOT) + 1))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    w = windows.select(
        "conv_id",
        F.struct(
            "window_no",
            F.size(own).cast("long").alias("n"),
            F.array_join(F.transform(plain, lambda x: F.concat(x, F.lit("\n"))), "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    both = {k: F.array_join(F.col(f"w.{k}"), "") for k in ("turns", "loss")}
    total = {k: F.aggregate(F.col(f"w.{k}"), F.lit(0).cast("long"), lambda a, x: a + x) for k in ("n", "chars")}
    return g.select(
        "conv_id",
        total["n"].alias("n_turns"),
        F.sha2(both["turns"], 256).alias("turns_sha256"),
        F.length(both["loss"]).cast("long").alias("loss_chars"),
        F.sha2(both["loss"], 256).alias("loss_sha256"),
        total["chars"].alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
