import random
import re

import numpy as np
from pyspark.sql import functions as F

from colscope.llm import neardup
from colscope.llm.components import connected_components
from colscope.llm.neardup import Settings, near_duplicates, shingles
from colscope.llm.queries import QUERIES

THREE = Settings(words=3, percent=85)


def brute(rows, words, percent):
    """Component of each doc_id by comparing every pair that shares a shingle."""
    sets = {}
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        low, high = sorted((root(a), root(b)))
                        parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def compare(spark, rows, settings, df):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, settings).collect()}
    wanted = brute(rows, settings.words, settings.percent)
    assert found == wanted
    return wanted


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    wanted = compare(spark, rows, THREE, df)
    assert any(part != i for i, (_, part) in wanted.items())
    compare(spark, rows, Settings(), df)


def test_large_groups_and_borderline_pairs(spark):
    """Groups beyond the node limit, at similarities on both sides of the threshold."""
    rng = random.Random(5)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    for _ in range(150):  # copies with up to four changed words: some pairs link, some do not
        copy = list(base)
        for k in rng.sample(range(120), rng.randrange(5)):
            copy[k] = word()
        rows.append((len(rows), " ".join(copy)))
    for _ in range(60):  # documents that share half of their words only
        rows.append((len(rows), " ".join(base[:60] + [word() for _ in range(60)])))
    rng.shuffle(rows)
    compare(spark, rows, THREE, spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, make_docs):
    df = make_docs(
        (1, "a b c d e f g h"), (2, "A  B\tc d\ne f g h"), (3, None), (4, "  \n"), (5, ""), (6, "one"), (7, "One"),
        (8, "x y"), (9, "É y"), (10, "é y"), (2, "a b c d e f g h"), (None, "one"),
    ).withColumn("n_shingles", F.lit("clash")).withColumn("component_id", F.lit(1))
    found = near_duplicates(df, THREE).collect()
    assert len(found) == 12
    part = {r["doc_id"]: r["component_id"] for r in found}
    assert part == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, None: None}
    assert {r["doc_id"] for r in found if not r["kept"]} == {2, 7, None}
    assert {r["doc_id"]: r["n_shingles"] for r in found}[3] == 0
    assert near_duplicates(make_docs(), THREE).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}
    assert len(found) == 101


def test_all_texts_of_an_id_share_a_component(spark, make_docs):
    rows = [(3, "p q r s"), (5, "p q r s"), (5, "u v w x y z"), (9, "u v w x y z"), (9, None), (11, "alone in here"), (12, "")]
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_duplicates(make_docs(*rows), Settings(words=3, percent=85)).collect()}
    assert {k: v for k, v in found.items() if k[0] in (3, 5, 9)} == {
        (3, 2): (3, True), (5, 2): (3, False), (5, 4): (3, False), (9, 4): (3, False), (9, 0): (3, False),
    }
    assert found[11, 1] == (11, True) and found[12, 0] == (12, True)


def test_nodes_that_are_open_after_the_last_level_are_compared(spark, make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEVELS", 1)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(120):  # two families that meet in the same nodes
        words = list(base) if k % 2 else base[:30] + [f"v{j}" for j in range(30)]
        words[rng.randrange(60)] = f"x{k}"
        texts.append(" ".join(words))
    settings = Settings(words=1, percent=80, trees=2, node_limit=3, outsiders=(0, 0))
    expected = {(r["doc_id"], r["component_id"]) for r in near_duplicates(make_docs(*texts), Settings(words=1, percent=80)).collect()}
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(make_docs(*texts), settings).collect()} == expected


def test_whole_table_by_exact_links(spark):
    """Components at sf0.1 against an exact join on the rarest shingles of each set."""
    folder, percent = "/root/testdata/sf0.1", 85
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op8_minhash_neardup"](spark, folder).collect()}
    sets = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        values = shingles(None if r["text"] is None else r["text"].encode(), 3)
        if len(values):
            sets.setdefault(values.tobytes(), []).append(r["doc_id"])
    classes = [(np.frombuffer(k, np.uint64), min(v)) for k, v in sets.items()]
    number, counts = np.unique(np.concatenate([v for v, _ in classes]), return_counts=True)
    parent = {i: i for _, i in classes}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    held, index = {}, {}
    for values, i in sorted(classes, key=lambda x: len(x[0])):
        ranked = values[np.lexsort((values, counts[np.searchsorted(number, values)]))]
        prefix = ranked[: len(values) - -(-percent * len(values) // 100) + 1].tolist()
        for j in {j for x in prefix for j in index.get(x, ())}:
            if 100 * len(held[j]) >= percent * len(values):
                both = len(np.intersect1d(values, held[j], assume_unique=True))
                if 100 * both >= percent * (len(values) + len(held[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        held[i] = values
        for x in prefix:
            index.setdefault(x, []).append(i)
    for k, v in sets.items():
        for doc in v:
            assert found[doc] == root(min(v))
