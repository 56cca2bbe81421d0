import zlib
from collections import Counter

from pyspark.sql import functions as F

from colscope.llm import language
from colscope.llm.queries import QUERIES


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for w in words:
        found.update(w)
        found.update(x + y for x, y in zip(" " + w, w + " "))
        found.update(f"{x}{y}{z}" for x, y, z in zip(" " + w, w + " ", (w + " ")[1:] if len(w) else ""))
    return found


def number(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_grams_and_pieces(monkeypatch):
    texts = ["", "a", "Ab c.", "  über den Wolken!! muß 123 x", "no1letters2", "- -", "x" * 50, "a b c d e f g " * 9]
    for piece in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(language, "PIECE", piece)
        for text in texts:
            keys, totals = language.grams(text)
            assert dict(zip(keys.tolist(), totals.tolist())) == {number(g): n for g, n in brute_grams(text).items()}, text


def test_held_out_accuracy_and_profiles(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    found = {r["doc_id"]: r for r in QUERIES["op10_rank_order_language"](spark, folder).collect()}
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in held} == {i for i, x in found.items() if x["held_out"]}
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) > 0.98 * len(held)
    assert all(0 <= x["score"] <= 1 for x in found.values())
    profiles = {}
    for r in language.learn(language.training_part(docs)).collect():
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    sums = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    for lang, total in sums.items():
        ranked = sorted(total, key=lambda g: (-total[g], number(g)))[: language.PROFILE]
        assert profiles[lang] == {number(g): k for k, g in enumerate(ranked)}
    for r in rows[:200]:
        total = brute_grams(r["text"])
        own = sorted(total, key=lambda g: (-total[g], number(g)))[: language.PROFILE]
        far = {
            lang: sum(abs(k - p[number(g)]) if number(g) in p else language.PROFILE for k, g in enumerate(own))
            for lang, p in profiles.items()
        }
        assert found[r["doc_id"]]["lang_pred"] == min(sorted(far), key=far.get)


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, None), (1, "12 !"), (None, "the cat"), (3, "the cat sat"), (4, ""), (3, "the cat sat")).withColumn("score", F.lit("x"))
    found = language.identify(docs, language.learn(docs)).collect()
    assert sorted(r["lang_pred"] for r in found) == ["en"] * 3 + ["und"] * 3
    nothing = language.identify(docs, language.learn(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.identify(make_docs(), language.learn(make_docs())).count() == 0


def test_rank_limit_comes_before_the_shuffle(spark):
    plan = language.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
