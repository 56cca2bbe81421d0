import random
import time

from pyspark.sql import functions as F

from colscope.llm import decontaminate
from colscope.llm.decontaminate import Block, clean, find, joined, least_distance, plain
from colscope.llm.queries import QUERIES


def table_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[:], 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(above[i] + 1, row[i - 1] + 1, above[i - 1] + (p != c))
        best = min(best, row[-1])
    return best


def edited(rng, text, edits):
    for _ in range(edits if len(text) > edits else 0):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "q", text[i] + "z"]) + text[i + 1 :]
    return text


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(400):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(60))) + edited(rng, pattern, rng.randrange(4))
        assert least_distance(pattern, text)[0] == table_distance(pattern, text)


def test_edited_items_are_found_and_no_others():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    block = Block(items, 5)
    for item, text in items:
        for edits in (0, 1, 2, 3, 5):
            doc = plain(" ".join([*(word() for _ in range(20)), edited(rng, text, edits), *(word() for _ in range(20))]))
            found = {i: d for i, d, _ in block.matches(doc)}
            wanted = {i: table_distance(plain(t), doc) for i, t in items}
            assert found == {i: d for i, d in wanted.items() if d <= len(plain(items[i][1])) * 5 // 100}


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    found = {r["doc_id"]: set(r["item_ids"]) for r in QUERIES["op1_pigeonhole_decontamination"](spark, folder).collect()}
    assert len(found) == len(docs) and any(found.values())
    for d in docs:
        text = plain(d["text"])
        assert {x["item_id"] for x in items if plain(x["text"]) in text} <= found[d["doc_id"]]


def test_odd_rows_and_blocks(spark, make_docs, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = make_docs(
        (1, None), (1, ""), (None, f"x {item.upper()} y"), (3, "a" * 300_000 + item), (4, item[:30]), (5, item.replace("fox", "fax"))
    ).withColumn("matches", F.lit("clash"))
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "  "), (5, "river   bank")], "item_id long, text string")
    for size in (1 << 20, 70):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        rows = find(docs, benchmark).collect()
        found = sorted((str(r["doc_id"]), [(m["item_id"], m["distance"]) for m in r["matches"]]) for r in rows)
        full = [(1, 0), (2, 0), (5, 0)]
        assert found == [("1", []), ("1", []), ("3", full), ("4", []), ("5", [(1, 1), (2, 1), (5, 0)]), ("None", full)]
        assert sorted(r["doc_id"] for r in clean(docs, benchmark).collect()) == [1, 1, 4]
    assert find(make_docs(), benchmark).count() == 0
    assert clean(docs, benchmark.limit(0)).count() == 6


def test_null_item_id_and_a_repeated_passage(spark, make_docs):
    passage = "many words that stand in a passage of the benchmark and are shared by all of its items"
    items = [(None, passage + " first"), (2, passage + " first"), *((k, f"{passage} and then item {k} goes on in its own way") for k in range(3, 23))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"a {passage} first b", f"{passage} and " * 900, "clean"]
    found = {r["doc_id"]: r["matches"] for r in find(make_docs(*texts), benchmark).collect()}
    assert [(m["item_id"], m["distance"]) for m in found[0]] == [(None, 0), (2, 0)] and not found[2]
    started = time.time()
    Block(items, 5).matches(plain(texts[1]))
    assert time.time() - started < 5
    assert [r["doc_id"] for r in clean(make_docs(*texts), benchmark).collect()][-1] == 2


def test_joined_windows():
    assert list(joined([(0, 5), (3, 8), (8, 9), (11, 12), (11, 20)])) == [(0, 9), (11, 20)] and list(joined([])) == []


def test_clean_takes_one_block_at_a_time(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    benchmark = spark.createDataFrame([(k, f"benchmark passage {k}") for k in range(5)], "item_id long, text string")
    docs = make_docs(*[f"has benchmark passage {k}" for k in range(5)], "none")
    found = clean(docs, benchmark)
    assert [r["doc_id"] for r in found.collect()] == [5]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
