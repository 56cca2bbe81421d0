"""Preference pairs as one prompt and two masked completions, by DataFrame functions alone.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the
prompt; what follows on each side is a completion. A turn is ``<|role|>``, a line break, its text,
``<|end|>`` and a line break; ``<|`` inside a text becomes ``<\\|`` so that it cannot pose as a mark.
The mask of a completion lists the spans, in characters with the end exclusive, that are to be learned:
the text and end mark of its assistant turns.

A conversation is one training example and is gathered into one row; pairs never meet each other.

Defined cases: null texts are empty, a null role is ``unknown``; turns are ordered by number, then role
and text, repeated rows count once; a pair with one side has an empty prompt and one completion; equal
sides are all prompt; null pair ids form one pair; ``usable`` tells whether both completions have
something to learn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD = "concat('<|', coalesce(x.role, 'unknown'), '|>\\n')"
BODY = "concat(replace(coalesce(x.text, ''), '<|', '<\\\\|'), '<|end|>')"


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable``.

    Both inputs have ``pair_id, turn, role, text``. Each turn knows where its body starts and ends in the rendered side, so
    masks need no walk along a conversation. One exchange serves the turns and the pairs.
    """
    sides = [
        side.select("pair_id", F.lit(name).alias("side"), "turn", "role", "text")
        for side, name in ((chosen, "chosen"), (rejected, "rejected"))
    ]
    turns = sides[0].union(sides[1]).repartition("pair_id").distinct()
    head, body = (F.expr(f"length({x.replace('x.', '')})") for x in (HEAD, BODY))
    upto = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("end", (F.sum(head + body + 1).over(upto) - 1).cast("int")).withColumn("start", F.col("end") - body)
    turn = F.struct("turn", "role", "text", "start", "end")
    pairs = turns.groupBy("pair_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == name, turn))).alias(name) for name in ("chosen", "rejected")
    ])
    same = "a IS NOT NULL AND b IS NOT NULL AND a.role <=> b.role AND a.text <=> b.text"
    pairs = pairs.withColumn(
        "prefix_turns",
        F.expr(f"CAST(array_position(concat(zip_with(chosen, rejected, (a, b) -> {same}), array(false)), false) - 1 AS INT)"),
    )
    cut = pairs.select(
        "pair_id", "prefix_turns",
        F.expr("slice(chosen, 1, prefix_turns)").alias("prompt"),
        F.expr("IF(prefix_turns > 0, chosen[prefix_turns - 1].end + 1, 0)").alias("prompt_length"),
        *[F.expr(f"slice({name}, prefix_turns + 1, size({name}))").alias(name) for name in ("chosen", "rejected")],
    )
    mask = "transform(filter({0}, x -> x.role = 'assistant'), x -> named_struct('start', x.start - prompt_length, 'end', x.end - prompt_length)) AS {0}_mask"
    return cut.select(
        "pair_id", "prefix_turns",
        *[F.expr(f"array_join(transform({name}, x -> concat({HEAD}, {BODY}, '\n')), '')").alias(name) for name in ("prompt", "chosen", "rejected")],
        *[F.expr(mask.format(name)) for name in ("chosen", "rejected")],
    ).withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def with_neighbours_answer(turns: DataFrame) -> DataFrame:
    """Rejected counterparts of conversations, for tables without preferences.

    The last assistant turn of a conversation gets the text of the last assistant turn of its neighbour
    (ids 2k and 2k + 1); other turns, and conversations whose neighbour has no answer, stay.
    """
    answers = turns.filter("role = 'assistant' AND conv_id IS NOT NULL").groupBy("conv_id")
    answers = answers.agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("answer"))
    mate = F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))
    swapped = answers.select("conv_id", "last").join(answers.select(mate.alias("conv_id"), "answer"), "conv_id")
    here = (F.col("role") == "assistant") & (F.col("turn") == F.col("last")) & F.col("answer").isNotNull()
    return turns.select("conv_id", "turn", "role", "text").join(swapped, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(here, F.col("answer")).otherwise(F.col("text")).alias("text")
    )
