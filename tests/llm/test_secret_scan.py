import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from colscope.llm import secret_scan
from colscope.llm.queries import QUERIES
from colscope.llm.secret_scan import base_spans, find, redact, redacted, spans, text_of, train

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_on_random_texts():
    rng = random.Random(2)
    parts = ["password", "PassWd", "api_key", "APIKEY", "toKen", "ſecret", "=", ": ", '"', "'", " ", "AKIA", "AKIAAKIA",
             "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "ä", "x", ".", "/", "zz=", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base_spans(text) == brute(text), text


def test_query_and_models(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in QUERIES["op7_markov_secrets"](spark, folder).collect()}
    assert found.keys() == texts.keys()
    extra = 0
    for i, text in texts.items():
        base = brute(text)
        assert [found[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert found[i]["base_sha256"] == hashlib.sha256(text_of(base).encode()).hexdigest()
        own = found[i]["spans"].split(",") if found[i]["spans"] else []
        assert set(text_of(base).split(",")) - {""} <= set(own)
        extra += len(own) - len(base)
    ratios = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rng = random.Random(9)
    made = ["".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in range(300)]
    caught = sum(any(kind == 3 for _, kind, _ in spans(f"the {x} of", ratios)) for x in made)
    assert caught >= 0.95 * len(made)
    words = {w for t in texts.values() for w in re.findall("[A-Za-z0-9_]{8,}", t) if not brute(w)}
    joined = [f"{a}_{b}_{k}{k + 1}" for k, (a, b) in enumerate(zip(sorted(words)[:400], sorted(words, key=hash)[:400]))]
    assert sum(bool(spans(x, ratios)) for x in joined) <= 0.02 * len(joined)
    assert extra <= 0.01 * len(texts)


def test_odd_rows(spark, make_docs):
    key = "AKIA" + "ABCDEFGH12345678"
    docs = make_docs((1, None), (1, ""), (None, f"é {key} é"), (3, "y " * 200_000 + "token=abcdef"), (4, "token=abc")).withColumn("spans", F.lit(0))
    ratios = train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    found = sorted((str(r["doc_id"]), r["spans"]) for r in find(docs, ratios).collect())
    assert found == [("1", ""), ("1", ""), ("3", "assign:400000:400012"), ("4", ""), ("None", "access:2:22")]
    clean = {r["doc_id"]: r for r in redact(docs.filter("doc_id IS NULL OR doc_id > 1"), ratios).collect()}
    assert clean[None]["text"] == "é [access] é" and clean[None]["n_chars"] == 12 and clean[None]["spans"] == 0
    assert clean[3]["text"].endswith(" [assign]") and clean[4]["text"] == "token=abc"
    assert redact(docs, ratios).filter("text IS NULL").count() == 1
    assert find(make_docs(), ratios).count() == 0


def test_recall_by_length_and_parts_of_runs(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ratios = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rng = random.Random(4)
    mixed, letters = string.ascii_letters + string.digits, string.ascii_letters
    made = lambda of, n: "".join(rng.choices(of, k=n))
    for of in (mixed, letters):
        recall = {}
        for n in (5, 6, 7, 8, 10, 12, 16, 20, 24, 32):
            texts = [f"the {made(of, n)} of" for _ in range(1000)]
            recall[n] = sum((4, 3, 4 + n) in spans(t, ratios) for t in texts) / 1000
        print(len(of), "characters, recall by length:", recall)
        assert recall[8] >= 0.95 and min(recall[n] for n in recall if n >= 10) >= 0.98
    for _ in range(50):
        left, right = made("GHJKLMNPQRTVWXYZ23456789", 16), made("GHJKLMNPQRTVWXYZ23456789", 16)
        text = f"the {left}{made('0123456789abcdef', 32)}{right} of"
        assert [kind for _, kind, _ in spans(text, ratios)] == [3, 2, 3]
        assert left[:8] not in redacted(text, ratios) and right[-8:] not in redacted(text, ratios)


def test_training_on_a_long_list_of_hashes(spark, make_docs):
    lines = "\n".join(f"{k:032x} file_name_{k}" for k in range(100_000))  # about 5 MB
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    started = time.time()
    ratios = secret_scan.train(make_docs(lines), labels)
    assert time.time() - started < 30 and ratios.shape[1] == len(secret_scan.ALPHABET)
