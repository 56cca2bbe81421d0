"""Quality by importance resampling: hashed n-gram models of good and of all text, Gumbel top-k.

Words in lower case and pairs of neighbouring words are hashed into ``WORDS`` and ``PAIRS`` buckets; two marks
at the end of a word count as a word of their own, and so does a run of ``RUN`` or more equal words. A document counts a
bucket once, so that words which one text repeats do not pass for a trait of many. The target model counts the n-grams of ``TARGET``
documents labelled good (quality 1, not toxic), the raw model those of all documents. Each bucket's log ratio is smoothed by
``PRIOR`` expected counts and drawn towards zero by ``DEAD``, so that differences which chance or the
mix of languages can make have no weight. These are fixed counts, which rare n-grams do not reach. So labelled
documents are asked as well: where the share of good ones among those that hold a bucket is below their share among all
labelled ones by a factor of e ** ``GATE`` or more, the bucket weighs at least what the highest share within ``BOUND``
nats of the best likelihood gives, however small the corpus or the language is. The mean over the target is taken off, so that long texts
gather nothing by collisions of buckets. A document's log weight is the sum over its n-grams; above
zero it counts as zero, as good text is not to be preferred for its length.

The sample takes the k largest ``SHARP * log weight + Gumbel noise``, which draws k documents without
replacement in proportion to the sharpened weights. k is the number of documents whose log weight is
at least a cutoff; labelled documents choose the cutoff that gains most: share of the others rejected
minus ``PRICE`` times the share of good ones rejected. The k-th largest key is found by counts in bins,
never by sorting or gathering keys. The noise depends on ``doc_id`` and ``SEED`` alone.

Defined cases: null and wordless texts have no n-grams and log weight zero; null ids are sampled by
one common noise; several labels of a document count as the worst; without good or without other
labels nothing is rejected; repeated rows share their fate, ties at the k-th key all stay; an empty
table gives an empty result; other columns are ignored, ``resample`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colscope.llm.common import id_and_text, map_rows, mix, pieces, sampled_ids, save, unit

#: Buckets of words, which are rare and telling, and of pairs.
WORDS, PAIRS = 1 << 20, 1 << 16
BUCKETS = WORDS + PAIRS
PRIOR, DEAD = 6.0, 0.6
#: Nats below the best likelihood that bound the share of good documents, and the log of the factor it must miss.
BOUND, GATE = 3.0, 1.5
SHARP, PRICE, SEED = 4.0, 20.0, 77
#: Good documents that the target model counts, and other labelled ones beside them, about, at most.
TARGET = 200_000
#: Log weights below this count as this; cutoffs are tried in steps of 1 / ``STEPS``.
FLOOR, STEPS = -64.0, 4
SAME, RUN = np.uint64(0x2545F4914F6CDD1D), 8
MARKS = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def buckets(text: bytes | None) -> np.ndarray:
    """The buckets of the words and word pairs of a text, each once."""
    words = [] if text is None else text.lower().split()
    ones = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = mix(ones[:-1] * np.uint64(0x9E3779B97F4A7C15) + ones[1:])
    run = np.arange(len(pairs))
    run -= np.maximum.accumulate(np.where(ones[:-1] == ones[1:], -1, run))
    marks = {w[-2:] for w in words if w[-1] in MARKS and len(w) > 1 and w[-2] in MARKS}
    ends = np.fromiter(map(xxhash.xxh3_64_intdigest, marks), np.uint64, len(marks))
    runs = np.full(int((run >= RUN - 1).any()), SAME)
    ones = np.concatenate([ones, ends, runs]) % np.uint64(WORDS)
    pairs = np.uint64(WORDS) + pairs % np.uint64(PAIRS)
    return np.unique(np.concatenate([ones, pairs]).astype(np.int64))


def good_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` for labelled documents."""
    worst = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    worst = worst.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return worst.select("doc_id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"))


def highest_share(good: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The highest share whose binomial log-likelihood is at most ``BOUND`` below that of the share seen."""
    seen = good / of

    def likelihood(share: np.ndarray) -> np.ndarray:
        return good * np.log(np.maximum(share, 1e-300)) + (of - good) * np.log(np.maximum(1 - share, 1e-300))

    least, low, high = likelihood(seen) - BOUND, seen, np.ones(len(seen))
    for _ in range(40):
        middle = (low + high) / 2
        within = likelihood(middle) >= least
        low, high = np.where(within, middle, low), np.where(within, high, middle)
    return high


def bounds(target: np.ndarray, other: np.ndarray, base: float) -> np.ndarray:
    """What labels alone say against each bucket: a log ratio of zero or less."""
    labelled = target + other
    found = np.zeros(len(target))
    at = np.flatnonzero((other > 0) & (target <= np.exp(-GATE) * base * labelled))
    found[at] = np.minimum(0.0, np.log(highest_share(target[at], labelled[at]) / base))
    return found


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket. What reaches the driver has ``BUCKETS`` + 1 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, BUCKETS + 1), np.int64)  # the last place counts documents
        for batch in batches:
            for part in pieces(batch):
                for text, good in zip(part["text"].to_pylist(), part["good"].to_pylist()):
                    found = np.append(buckets(text), BUCKETS)
                    counts[2, found] += 1
                    if good is not None:
                        counts[0 if good else 1, found] += 1
        where = np.flatnonzero(counts[2])
        yield pa.RecordBatch.from_arrays([pa.array(where), *(pa.array(c[where]) for c in counts)], names=["bucket", *names])

    names = ("target", "other", "raw")
    labelled = good_ids(labels)
    good, rest = (
        sampled_ids(labelled.filter(F.col("good") == side), TARGET, SEED).withColumn("good", F.lit(side)) for side in (True, False)
    )
    marked = id_and_text(docs).join(F.broadcast(good.union(rest)), "doc_id", "left").select("text", "good")
    found = marked.mapInArrow(run, "bucket long, target long, other long, raw long").groupBy("bucket")
    summed = found.agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    table = np.zeros((3, BUCKETS + 1))
    table[:, summed["bucket"].to_numpy()] = [summed[c].to_numpy() for c in names]
    counts, sizes = table[:, :BUCKETS], dict(zip(names, table[:, BUCKETS]))
    target, other, raw = counts
    if not sizes["target"]:
        return np.zeros(BUCKETS)
    expected = raw * (sizes["target"] / sizes["raw"])
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD, 0.0)
    ratio = np.minimum(ratio, bounds(target, other, sizes["target"] / (sizes["target"] + sizes["other"])))
    return ratio - (target @ ratio) / target.sum()


def log_weight(text: bytes | None, ratios: np.ndarray) -> float:
    return float(max(FLOOR, min(0.0, ratios[buckets(text)].sum())))


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight`` for each row."""
    table = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            yield doc_id, log_weight(text, table.value)

    return map_rows(id_and_text(docs), "doc_id long, log_weight double", rows)


def key_of(log_weight: str):
    """The Gumbel key of a document, in steps of 2 ** -30."""
    noise = -F.log(-F.log(unit(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), seed=SEED)))
    return F.floor((F.lit(SHARP) * F.col(log_weight) + noise) * (1 << 30)).cast("long")


def cutoff(weighed: DataFrame, labels: DataFrame) -> float:
    """The log weight that best parts good from other labelled documents; ``FLOOR`` if none gains."""
    bins = weighed.join(good_ids(labels), "doc_id").groupBy("good", F.floor(F.col("log_weight") * STEPS).alias("bin"))
    counts = {(r["good"], r["bin"]): r["n"] for r in bins.agg(F.count("*").alias("n")).collect()}
    totals = {side: sum(n for (s, _), n in counts.items() if s == side) for side in (True, False)}
    best, most = FLOOR, 0.0
    lost = dict.fromkeys(totals, 0)
    if all(totals.values()):
        for at in range(int(FLOOR * STEPS), 0):
            for side in lost:
                lost[side] += counts.get((side, at), 0)
            gain = lost[False] / totals[False] - PRICE * lost[True] / totals[True]
            if gain > most:
                best, most = (at + 1) / STEPS, gain
    return best


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a long column, by counts in bins that narrow until one value is left."""
    if k < 1:
        return None
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) // bins + 1
        counted = df.filter(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - low) / width).alias("bin"))
        counts = {r["bin"]: r["n"] for r in counted.agg(F.count("*").alias("n")).collect()}
        for at in sorted(counts, reverse=True):
            if counts[at] >= k:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            k -= counts[at]
        else:
            return low
    return low


def _keys(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame, int | None]:
    """The log ratios, ``doc_id, log_weight, key`` for each row, and the least key of the sample."""
    ratios = log_ratios(docs, labels)
    weighed = save(log_weights(docs, ratios).withColumn("key", key_of("log_weight")), "weighed")
    k = weighed.filter(F.col("log_weight") >= cutoff(weighed, labels)).count()
    return ratios, weighed, kth_largest(weighed, "key", k)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, log_weight, key, kept`` for each row."""
    _, weighed, least = _keys(docs, labels)
    kept = F.lit(False) if least is None else F.col("key") >= least
    return weighed.select("doc_id", "log_weight", "key", kept.alias("kept"))


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the sample takes, as they are."""
    ratios, _, least = _keys(docs, labels)
    if least is None:
        return docs.limit(0)
    table = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))
    extra = "log_weight" + "_" * max(map(len, docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = (None if t is None else t.encode("utf-8") for t in part["text"].to_pylist())
                weights = pa.array([log_weight(t, table.value) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, weights], names=[*part.schema.names, extra])

    weighed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(extra, DoubleType())]))
    return weighed.filter(key_of(extra) >= least).drop(extra)
