"""Preference formatting of chat pairs: the longest common prefix of turns is rendered once, the rest as masked completions.

Two conversations agree up to the first turn at which role or text differ or one of them has no such turn. That turn is
found by a join of the turns by (pair, turn) and a minimum per pair that combines before the shuffle. Then each pair is one
row: its turns are put into the parts prompt, chosen and rejected. Only a pair with more than `most` characters on both sides
together has several rows, numbered by `part`, each of whole turns: the parts put together in order are what one row would
have held, so nothing is lost, and no task ever holds more than a part (or one single longer turn).

Each part is the rendered text with a mask: an array of (start, length) in characters that a loss may count, namely what
the assistant says in a completion and the end mark after it. A prompt has no such spans. In a pair of several rows the mask
counts within its row.

Rows without conv_id or turn are dropped. Null role is `user`, null text is empty. Of several rows with one (conv_id,
turn) the smallest (role, text) counts. Pairs whose conversations are both missing give no row; a pair with one missing has
an empty prompt and an empty completion there. Equal conversations have everything in the prompt and empty completions. A pair_id
that several pairs have is an error of the caller's: their turns would mix. Columns other than those named here are ignored. Empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, scanned

#: Characters of a pair, of both conversations together, up to which it is one row.
MOST = 16 << 20
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
SPANS = "array<struct<start:long,length:long>>"


def _opening(role: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), role, F.lit(after))


def turns_of(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    return rows.select("conv_id", "turn", "said.role", "said.text")


def format_pairs(conversations: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(pair_id, part, prefix_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) for pairs (pair_id, chosen_id, rejected_id)."""
    turns = materialize(turns_of(conversations), "turns")
    side = lambda name: pairs.select("pair_id", F.col(f"{name}_id").alias("conv_id")).join(turns, "conv_id").select("pair_id", "turn", "role", "text")
    chosen, rejected = side("chosen").withColumn("c", F.lit(True)), side("rejected").withColumn("r", F.lit(True))
    both = chosen.withColumnsRenamed({"role": "c_role", "text": "c_text"}).join(rejected.withColumnsRenamed({"role": "r_role", "text": "r_text"}), ["pair_id", "turn"], "full")
    both = both.withColumn("same", F.coalesce((F.col("c_role") == F.col("r_role")) & (F.col("c_text") == F.col("r_text")), F.lit(False)))
    marks = len(OPEN) + len(CLOSE)
    weight = sum((F.coalesce(F.length(f"{x}_role") + F.length(f"{x}_text") + marks, F.lit(0)) for x in "cr"), F.lit(0))
    both = materialize(both.withColumn("weight", weight.cast("long")), "both")
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("first"), F.sum("weight").alias("whole"))
    split = materialize(split, "split")
    rows = both.join(split.select("pair_id", "first"), "pair_id").withColumn("shared", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    # where a long pair is cut: running sums over its turns, without their texts
    lengths = both.join(split.where(F.col("whole") > most).select("pair_id"), "pair_id", "left_semi").select("pair_id", "turn", "weight")
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("pair_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lengths.select("pair_id", "turn", F.floor(before / most).alias("part"))
    rows = rows.join(parts, ["pair_id", "turn"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    told = lambda x: F.struct("turn", F.col(f"{x}_role").alias("role"), F.col(f"{x}_text").alias("text"))
    rows = rows.groupBy("pair_id", "part").agg(
        F.count_if("shared").alias("prefix_turns"),
        F.array_sort(F.collect_list(F.when(F.col("shared"), told("c")))).alias("p"),
        F.array_sort(F.collect_list(F.when(~F.col("shared") & F.col("c"), told("c")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("shared") & F.col("r"), told("r")))).alias("r"),
    )
    rendered = lambda x: F.array_join(F.transform(x, lambda t: F.concat(_opening(t["role"]), t["text"], F.lit(CLOSE))), "")

    opening, closing = OPEN.format(""), len(CLOSE)

    def step(at: str, t: str) -> tuple[str, str]:
        opened, said = f"{at} + length({t}.role) + {len(opening)}", f"cast(length({t}.text) + {closing} as bigint)"
        span = f"array(named_struct('start', {opened}, 'length', {said}))"
        return f"{opened} + {said}", f"CASE WHEN {t}.role = 'assistant' THEN {span} ELSE cast(array() as {SPANS}) END"

    mask = lambda x: F.expr(scanned(x, "0L", SPANS, step))
    return rows.select("pair_id", "part", "prefix_turns", rendered("p").alias("prompt"), rendered("c").alias("chosen"), mask("c").alias("chosen_mask"), rendered("r").alias("rejected"), mask("r").alias("rejected_mask"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected): a stated pairing for tables without preferences."""
    ids = conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
