import time

import pytest
from pyspark.sql import functions as F

from colscope.llm.preference import format_preferences

TURNS = "pair_id long, turn long, role string, text string"


def brute(chosen, rejected):
    def render(turns):
        text, spans = "", []
        for _, role, body in turns:
            head = f"<|{role or 'unknown'}|>\n"
            body = (body or "").replace("<|", "<\\|") + "<|end|>"
            if role == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(body)))
            text += head + body + "\n"
        return text, spans

    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k][1:] == rejected[k][1:]:
        k += 1
    (a, x), (b, y) = render(chosen[k:]), render(rejected[k:])
    return k, render(chosen[:k])[0], a, b, x, y, bool(x and y)


CASES = {
    1: ([(0, "user", "hi"), (1, "assistant", "yes <|end|>"), (2, "user", "more")], [(0, "user", "hi"), (1, "assistant", "no"), (2, "user", "more")]),
    2: ([(0, "user", "a"), (1, "assistant", "b")], [(0, "user", "a"), (1, "assistant", "b")]),
    3: ([(0, "user", "a")], [(0, "user", "a"), (1, "assistant", "ä€😀"), (2, "user", None), (3, "assistant", "")]),
    4: ([(0, "assistant", "only one side")], []),
    5: ([(0, None, None), (1, "assistant", "x")], [(0, None, None), (1, "assistant", "y" * 200_000)]),
    6: ([(0, "system", "s"), (0, "user", "same turn"), (1, "assistant", "x")], [(0, "system", "s"), (0, "user", "other"), (1, "assistant", "x")]),
}


@pytest.mark.parametrize("repeat", [1, 2])
def test_cases(spark, repeat):
    sides = [
        spark.createDataFrame([(p, *t) for p, both in CASES.items() for t in both[side]] * repeat, TURNS).withColumn("prompt", F.lit(1))
        for side in (0, 1)
    ]
    found = {r["pair_id"]: r for r in format_preferences(*sides).collect()}
    assert found.keys() == CASES.keys()
    for p, both in CASES.items():
        r = found[p]
        masks = [[tuple(x) for x in r[c]] for c in ("chosen_mask", "rejected_mask")]
        assert (r["prefix_turns"], r["prompt"], r["chosen"], r["rejected"], *masks, r["usable"]) == brute(*both), p
    assert format_preferences(sides[0].limit(0), sides[1].limit(0)).count() == 0


def test_main_path_has_no_python(spark, sf):
    from colscope.llm.queries import QUERIES

    plan = QUERIES["op5_preference_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_very_long_conversation(spark):
    turns = spark.range(100_000).selectExpr("1L AS pair_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    other = turns.withColumn("text", F.when(F.col("turn") < 10, F.col("text")).otherwise("x"))
    started = time.time()
    row = format_preferences(turns, other).selectExpr(
        "prefix_turns", "size(chosen_mask) AS n", "element_at(chosen_mask, -1).end AS last", "length(chosen) AS length", "rejected_mask[0] AS first"
    ).first()
    assert time.time() - started < 30
    assert row["prefix_turns"] == 10 and row["n"] == 49_995 and row["last"] == row["length"] - 1
    start = len("<|user|>\nx<|end|>\n<|assistant|>\n")
    assert (row["first"]["start"], row["first"]["end"]) == (start, start + len("x<|end|>"))
