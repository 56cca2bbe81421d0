import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from colscope.llm import resampling as R
from colscope.llm.queries import QUERIES


def test_ratios_by_hand(spark, make_docs):
    docs = make_docs((1, "a b a b"), (2, "c c c"), (3, None))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    ratios = R.log_ratios(docs, labels)
    bucket = lambda w: xxhash.xxh3_64_intdigest(w) % R.WORDS
    shrunk = lambda t, n: math.copysign(max(abs(x := math.log((t + R.PRIOR) / (n / 3 + R.PRIOR))) - R.DEAD, 0), x)
    mean = shrunk(1, 1)  # all n-grams of the one good document of three
    for word, t, n in ((b"a", 1, 1), (b"c", 0, 1)):
        assert math.isclose(ratios[bucket(word)], shrunk(t, n) - mean, abs_tol=1e-12)
    assert set(R.buckets(b"A b a")) >= {bucket(b"a"), bucket(b"b")} and len(R.buckets(b"a " * 8)) == 3 and len(R.buckets(b"a " * 7)) == 2
    assert len(R.buckets(None)) == len(R.buckets(b" ")) == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.randrange(-10**12, 10**12) for _ in range(500)] + [5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 250, len(values)):
        assert R.kth_largest(df, "v", k) == ranked[k - 1]
    assert R.kth_largest(df, "v", 0) is None and R.kth_largest(df.limit(0), "v", 3) is None


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.filter("doc_id % 2 = 0")
    kept = {r["doc_id"]: r["kept"] for r in R.sample(docs, learned).collect()}
    held = [r for r in labels.filter("doc_id % 2 = 1").collect() if r["doc_id"] in kept]
    share = lambda rows: np.mean([kept[r["doc_id"]] for r in rows])
    good, poor, toxic = (share([r for r in held if (r["quality"], r["toxic"]) == x]) for x in ((1, 0), (0, 0), (1, 1)))
    print("kept of held-out good, poor, toxic:", good, poor, toxic)
    assert good >= 0.97 and poor <= 0.6 and toxic <= 0.5
    query = QUERIES["op4_importance_resampling"](spark, folder)
    assert query.count() == docs.count()


def test_resample_agrees_with_sample(spark, make_docs):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=80) + (["rot"] * 12 if i % 4 == 0 else []))) for i in range(400)]
    docs = make_docs(*rows, (None, "w1 w2"), (7, None)).withColumn("log_weight", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = sorted(str(r["doc_id"]) for r in R.sample(docs, labels).filter("kept").collect())
    found = R.resample(docs, labels)
    assert found.columns == docs.columns and sorted(str(r["doc_id"]) for r in found.collect()) == kept
    assert sum(i % 4 == 0 for i in map(int, filter(str.isdigit, kept))) <= 5 and len(kept) >= 295
    assert R.sample(docs, labels.limit(0)).filter("kept").count() == 402
    assert R.sample(make_docs(), labels).count() == 0 and R.resample(make_docs(), labels).count() == 0


def test_toxic_words_of_small_languages(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "lang").join(labels, "doc_id").collect()

    def kept(learned, held):
        found = {r["doc_id"]: r["kept"] for r in R.sample(docs, learned).collect()}
        of = lambda lang: [found[r["doc_id"]] for r in rows if held(r) and r["toxic"] == 1 and r["quality"] == 1 and r["lang"] == lang]
        return {lang: np.mean(of(lang)) for lang in ("en", "de", "fr", "es")}

    known, unseen = kept(labels, lambda r: True), kept(labels.filter("doc_id % 2 = 0"), lambda r: r["doc_id"] % 2 == 1)
    print("kept toxic, all labels:", known, "held out:", unseen)
    assert known["en"] <= 0.02 and known["de"] <= 0.2 and known["fr"] <= 0.2 and known["es"] <= 0.5
    assert unseen["en"] <= 0.02 and unseen["de"] <= 0.4 and unseen["fr"] <= 0.4  # es: 17 toxic labels are left to learn from


def test_bounds_grow_with_evidence():
    target, other = np.array([0, 0, 0, 0, 3, 30]), np.array([1, 4, 8, 100, 1, 10])
    found = R.bounds(target, other, 0.75)
    assert found[0] == 0 and 0 > found[1] > found[2] > found[3] and not found[4:].any()
    assert math.isclose(found[2], math.log((1 - math.exp(-R.BOUND / 8)) / 0.75), abs_tol=1e-6)
