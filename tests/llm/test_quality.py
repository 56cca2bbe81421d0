import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from colscope.llm.quality import (
    NEVER, RULES, STEPS, Risk, at_most, base_failed, best_position, counts, cutoffs_of, judge, path_of,
)
from colscope.llm.queries import QUERIES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, copied = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copied += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, copied, len(inside), failed


def base(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


def test_binomial_tail_is_exact():
    for n, x, rate in [(10, 0, 0.1), (50, 3, 0.05), (400, 9, 0.01), (7, 7, 0.5), (30, 20, 0.5)]:
        p = Fraction(rate)
        wanted = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
        assert at_most(x, n, rate) == pytest.approx(float(wanted), rel=1e-9)


def test_positions_need_enough_clean_documents():
    assert best_position({NEVER: 1000}, {0: 50}, 0.001, Risk()) == 0
    assert best_position({NEVER: 1000}, {0: 50, 7: 5}, 0.001, Risk()) == 7
    assert best_position({NEVER: 100}, {0: 50}, 0.001, Risk()) is None
    assert best_position({NEVER: 900, 0: 100}, {0: 50}, 0.001, Risk()) is None
    assert best_position({NEVER: 900, 3: 100}, {0: 50, 3: 50}, 0.001, Risk()) == 0
    assert best_position({}, {}, 0.001, Risk()) is None


def test_path_takes_the_cheapest_parts_first():
    def ladder(**counts):
        return [counts.get(f"k{i}", 0) for i in range(STEPS + 1)]

    poor = [ladder(k2=30, k5=10, k60=60), ladder(k1=5, k60=95)]
    other = [ladder(k2=1, k5=50, k60=949), ladder(k60=1000)]
    found = path_of(poor, other)
    assert found[0][:6] == [0, 1, 2, 5, 6, 7] and found[1][:2] == [3, 4]
    assert all(k == NEVER for k in found[0][6:] + found[1][2:])


def test_union_of_rules_keeps_the_risk():
    """Good texts drawn anew: the chosen position rejects too many of them in at most 5 % of the draws."""
    rng = random.Random(5)
    rates, risk, broken = [0.0, 0.004, 0.004, 0.004, 0.05], Risk(), 0
    for _ in range(400):
        draws = Counter(rng.choices([*range(5), NEVER], [*rates, 1 - sum(rates)], k=900))
        best = best_position(draws, {k: 200 for k in range(5)}, risk.miss, risk)
        broken += best is not None and sum(rates[: best + 1]) > risk.risk
    assert broken <= 0.05 * 400 + 10


def test_cutoffs_against_brute_force(spark):
    """Positions, tests and cutoffs recomputed from the counts of each text."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    measured = counts(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    worst, sides, scores = {}, {}, {}
    for r in labels.collect():
        side = 2 if r["quality"] == 0 else int(r["quality"] == 1 and not r["toxic"])
        worst[r["doc_id"]] = max(side, worst.get(r["doc_id"], 0))
    wanted = [F.coalesce(F.expr(score), F.lit(-1.0)).alias(name) for name, (score, _) in RULES.items()]
    for r in measured.filter(~base_failed()).select("doc_id", "stratum", "text_hash", *wanted).collect():
        key = r["stratum"], bytes(r["text_hash"])
        sides[key] = max(sides.get(key, 0), worst.get(r["doc_id"], 0))
        scores[key] = [sum(not r[name] > c for c in cutoffs) for name, (_, cutoffs) in RULES.items()]
    strata = {s for s, _ in sides}
    n_good = {s: sum(1 for k, x in sides.items() if k[0] == s and x == 1) for s in strata}
    risk = Risk()
    able = [s for s in strata if 0.99 ** n_good[s] <= risk.miss]
    expected = {}
    for s in able:
        split = {x: [[0] * (STEPS + 1) for _ in RULES] for x in (0, 2)}
        for key, x in sides.items():
            if key[0] == s and x != 1:
                for i, k in enumerate(scores[key]):
                    split[x][i][k] += 1
        path = path_of(split[2], split[0])
        first = {x: Counter(min(path[i][k] for i, k in enumerate(scores[key])) for key, y in sides.items() if key[0] == s and y == x) for x in (1, 2)}
        best = best_position(first[1], first[2], risk.miss / len(able), risk)
        if best is not None:
            for i, (rule, (_, cutoffs)) in enumerate(RULES.items()):
                if taken := [k for k in range(STEPS) if path[i][k] <= best]:
                    expected[s, rule] = cutoffs[max(taken)]
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoffs_of(measured, labels).collect()}
    print(n_good, sorted(found.items()))
    assert found == expected and len({s for s, _ in found}) >= 2


def test_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op2_certified_rules"](spark, folder).collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for i, text in texts:
        assert base(found[i]) == brute(text)
        assert not (found[i]["kept"] and found[i]["base_failed"])
    sound = [i for i, x in labels.items() if i in found and not found[i]["base_failed"]]
    good = [i for i in sound if labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    poor = [i for i in sound if labels[i]["quality"] == 0]
    assert sum(not found[i]["kept"] for i in good) <= 0.01 * len(good)
    assert sum(not found[i]["kept"] for i in poor) >= 0.3 * len(poor)


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (1, ""), (2, " \n\t"), (None, "a b c a b c"), (3, "x " * 200_000), (4, "é|é\né|é\n\n\n"))
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise("xx"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = judge(docs, labels).collect()
    assert sorted(map(str, map(base, found))) == sorted(str(brute(r["text"])) for r in docs.collect())
    assert not any(r["kept"] for r in found)
    assert judge(make_docs(), labels).count() == 0
    assert judge(docs, labels.limit(0)).count() == 6
