import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import toxicity
from colscope.llm.queries import QUERIES
from colscope.llm.toxicity import Network, Words, fit, logits, score, spark_thresholds, threshold, thresholds, train

LABELS = "doc_id long, quality int, toxic int"


def numbered(texts):
    words = Words()
    return [words.of(t.split()) for t in texts], words.rows()


def test_logits_by_plain_convolution():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=n)) for n in (1, 3, 63, 64, 65, 200, 0, 70 * 64)]
    numbers, rows = numbered(texts)
    net = Network.new(np.random.default_rng(1))
    net.bias = 0.25
    embedded = net.embedded(rows)
    for text, found in zip(numbers, logits(net, rows, numbers)):
        if not len(text):
            assert found == 0.25
            continue
        padded = np.concatenate([embedded[text], np.zeros((toxicity.REACH, toxicity.SIZE))])
        values = np.concatenate([
            np.array([sum(padded[i + k] @ w[k] for k in range(len(w))) for i in range(len(text))]) for w in net.filters
        ], 1)
        tops = np.array([values[i : i + toxicity.REGION].max(0) for i in range(0, len(text), toxicity.REGION)])
        assert found == pytest.approx(np.concatenate([tops.max(0), tops.mean(0)]) @ net.out + 0.25, abs=1e-3)


def test_step_follows_the_gradient(monkeypatch):
    """What a step hands to Adam, against differences of the loss."""
    rng = random.Random(4)
    numbers, rows = numbered([" ".join(rng.choices("abcdefghijklmnop", k=n)) for n in (5, 80, 150, 20)])
    labels = np.array([True, False, True, False])
    net = Network.new(np.random.default_rng(3))
    net.table, net.filters, net.out = net.table.astype(float), [w.astype(float) for w in net.filters], net.out.astype(float)
    arrays = [net.table, *net.filters, net.out]
    seen = []

    class Held:
        def __init__(self, array):
            self.array = array

        def step(self, gradient, at=slice(None)):
            whole = np.zeros(self.array.shape)
            whole[at] = gradient
            seen.append(whole)

    def loss():
        z = logits(net, rows, numbers)
        return np.mean(np.log1p(np.exp(-np.where(labels, z, -z))))

    toxicity._step(net, [Held(a) for a in arrays], numbers, rows, labels, np.ones(4))
    net.bias = 0.0
    seen[-1] -= 1e-3 * net.out
    checked = 0
    for array, gradient in zip(arrays, seen):
        for at in np.argsort(-np.abs(gradient), axis=None)[:6]:
            flat, step = array.reshape(-1), 1e-5
            kept = flat[at]
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            down = loss()
            flat[at] = kept
            assert gradient.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-5)
            checked += 1
    assert checked == 6 * len(arrays)


def test_threshold_by_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(50):
        toxic, clean = rng.normal(1, 1, rng.integers(1, 30)).round(1), rng.normal(-1, 1, rng.integers(1, 60)).round(1)
        values = np.unique(np.concatenate([toxic, clean]))
        cuts = [values[0] - 1, *((values[1:] + values[:-1]) / 2), values[-1] + 1]
        gain = lambda t: (toxic >= t).mean() - toxicity.PRICE * (clean >= t).mean()
        assert gain(threshold(toxic, clean)) == pytest.approx(max(map(gain, cuts)))


def test_a_language_with_few_rows_takes_the_common_threshold():
    logit = np.concatenate([np.full(20, 5.0), np.full(20, 1.0), np.full(20, -3.0), np.full(20, -5.0), [0.0]])
    toxic = np.array([True] * 20 + [False] * 20 + [True] * 20 + [False] * 20 + [True])
    found = thresholds(logit, toxic, ["en"] * 40 + ["de"] * 40 + ["es"])
    assert found["en"] == 3.0 and found["de"] == -4.0 and "es" not in found and None in found


def test_held_out_documents_in_every_language(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op13_toxicity_cnn"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    known = found.join(docs, "doc_id").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    marked = {(r["lang"], r["toxic"]): r["p"] for r in known.groupBy("lang", "toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert {lang for lang, _ in marked} >= {"en", "de", "fr", "es"}
    for (lang, toxic), share in marked.items():
        assert share >= 0.8 if toxic else share <= 0.04, (lang, toxic, share)


def test_lang_source_and_id_do_not_count(spark, make_docs):
    texts = ["you idiot scum", "a kind word", "idiot", "fine day"] * 30
    docs = make_docs(*texts)
    labels = spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t in enumerate(texts)], LABELS)
    model = fit(docs, labels)
    plain = sorted((r["score"], r["predicted"]) for r in score(docs, model).collect())
    other = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'other' AS source", "n_chars")
    assert sorted((r["score"], r["predicted"]) for r in score(other, model).collect()) == plain
    assert [r["predicted"] for r in score(make_docs("such an idiot he is", "such a day it is"), model).orderBy("doc_id").collect()] == [1, 0]


def test_odd_rows(spark, make_docs):
    docs = make_docs((1, "idiot"), (1, "fool idiot"), (2, "good"), (2, "good"), (3, None), (4, ""), (None, "idiot"), (5, "!!!"), (6, "x " * 300_000))
    docs = docs.selectExpr("*", "'clash' AS toxic", "1 AS score", "0 AS predicted")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 0), (None, 1, 1), (4, None, None), (6, 1, 1)], LABELS)
    found = score(docs, fit(docs, labels)).collect()
    assert len(found) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4, 5)}) == 1
    assert fit(docs, labels.filter("toxic = 0")) is None
    assert {(r["score"], r["predicted"]) for r in score(docs, None).collect()} == {(0.0, 0)}
    nothing = docs.filter(F.lit(False))
    assert fit(nothing, labels) is None and score(nothing, None).count() == 0


def test_training_is_repeatable():
    numbers, rows = numbered(["a b c", "d e f", "a e", "f"] * 4)
    labels = np.array([True, False, True, False] * 4)
    one, two = (train(numbers, rows, labels) for _ in range(2))
    assert np.array_equal(one.table, two.table) and one.bias == two.bias
    z = logits(one, rows, numbers)
    assert z[labels].min() > z[~labels].max()


def test_all_labelled_documents_count(spark):
    """Each language has one document only, among more than a sample held before; one text is very long."""
    texts = [(k, f"word{k} fine day", f"l{k}" if k % 100 == 0 else "en") for k in range(5000)]
    texts += [(k, "you idiot scum", "en") for k in range(5000, 5100)] + [(6000, "kind " * 50_000, "long")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "CAST(text LIKE '%idiot%' AS int) AS toxic")
    model = fit(docs, labels)
    assert set(model.languages.names) == {lang for _, _, lang in texts}
    long = model.languages.logs[toxicity.rows_of("kind")[0]]
    assert model.languages.names[int(long.argmax())] == "long"


def test_shards_are_averaged(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 300)
    texts = [f"{'you idiot scum' if k % 3 == 0 else 'a fine day'} n{k}" for k in range(1500)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(1500)], LABELS)
    docs = make_docs(*texts)
    model = fit(docs, labels)
    assert [r["predicted"] for r in score(docs, model).orderBy("doc_id").collect()] == [int(k % 3 == 0) for k in range(1500)]
    again = fit(docs.repartition(3), labels)
    assert np.allclose(model.network.table, again.network.table, atol=1e-5) and model.thresholds == pytest.approx(again.thresholds, abs=1e-3)


def test_thresholds_of_a_table(spark):
    rng = np.random.default_rng(8)
    toxic = rng.random(800) < 0.4
    logit = (rng.normal(0, 1, 800) + toxic).round(2)
    names = rng.choice(np.array(["en", "de", "=", "*", None], object), 800, p=[0.5, 0.3, 0.17, 0.02, 0.01]).tolist()
    scored = spark.createDataFrame(list(zip(names, logit.tolist(), toxic.tolist())), "name string, logit double, toxic boolean")
    assert spark_thresholds(scored) == pytest.approx(thresholds(logit, toxic, names), abs=1e-12)
    assert spark_thresholds(spark.createDataFrame([(None, 1.0, True), (None, 1.0, False)], scored.schema)) == {None: 1.5}


def test_words_by_plain_pattern():
    """Words, their counts and rows from characters in one go, as a pattern and single words give them."""
    texts = ["", "Idiot, idiot! IDIOT_2", "...", "\u0130\u0130 Stra\u00dfe \u00c9T\u00c9 a\u0300b x\u0663 \U0001d7d8\U0001f600y", "a ab abc abcdefgh", "", "z" * (toxicity.STRETCH + 9) + " z"]
    for some in (texts, texts[:1], []):
        plain = [re.findall(r"\w+", text.lower()) for text in some]
        numbers, counts, rows = toxicity.spelled(some)
        flat = [word for words in plain for word in words]
        assert counts.tolist() == [len(words) for words in plain]
        assert len({*zip(numbers.tolist(), flat)}) == len(set(flat)) == len(rows)
        assert all(tuple(rows[n - 1]) == toxicity.rows_of(word) for n, word in zip(numbers.tolist(), flat))


def test_every_document_teaches_the_networks_that_score(spark, make_docs):
    """As many networks as folds; each leaves out one fold, and the score is of their mean logit."""
    texts = [f"{'you idiot scum' if k % 3 == 0 else 'a fine day'} n{k}" for k in range(300)]
    model = fit(make_docs(*texts), spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], LABELS))
    members = model.network.members
    assert len(members) == toxicity.FOLDS
    numbers, counts, rows = toxicity.spelled(texts)
    batch = toxicity.Batch.laid(numbers, counts, rows)
    mean = sum(toxicity.batch_logits(net, batch) for net in members) / len(members)
    found, names = model.scores(texts)
    cut = np.array([model.thresholds.get(name, model.thresholds[None]) for name in names])
    assert found == pytest.approx(1 / (1 + np.exp(cut - mean)), abs=1e-6)
    start = Network.new(np.random.default_rng(toxicity.SEED)).table
    taught = [(net.table != start).any(1) for net in members]
    own = rows[:, 0]
    seen = np.sum([t[own] for t in taught], 0)
    assert (seen >= toxicity.FOLDS - 1).mean() > 0.9  # but for words that never have a maximum
