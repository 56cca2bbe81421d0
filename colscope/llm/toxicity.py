"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word is a run of word characters in lower case. Its embedding is the sum of the rows that the word and its
first ``PREFIXES`` characters are hashed to, so that forms of one stem share what they learn. Filters
of ``WIDTHS`` words slide over the text; each takes its maximum in every region of ``REGION`` words. The largest and the
mean of these maxima over the regions go to a logistic layer: one hit counts, and so does how often hits occur. It is
trained by Adam on all labelled documents.

Labelled documents are dealt to shards of about ``SHARD``, by a hash, and become batches of ``BATCH`` texts as
numbers of words. In each of ``EPOCHS`` rounds every shard takes the parameters of the round before once through its
batches, then the shards' parameters are averaged: rows of the embedding table by the batches that touched them, the others by
documents. Only parameters are shuffled between rounds; the driver holds averages, of fixed size.

Thresholds are calibrated by language, but the ``lang`` of a document is never asked for when it is scored: a
naive Bayes model of words, counted over the same training rows, guesses the language from the text. ``FOLDS`` networks
are trained, each without one part of the rows, and score together by their mean logit: every row teaches all of them but one. The
logits of all rows, each by the network that has not seen it, give the threshold of a language, the one
that parts its toxic and clean rows best. With fewer than ``ENOUGH`` rows of either class it is the threshold of all
rows. The score is the logistic function of the logit above the threshold, so 0.5 is the cutoff in every language.

Texts are learned from and scored whole, in runs of words, whatever their length.

Defined cases: null, empty and wordless texts score by the bias alone, as texts of the pooled language;
several labels of a document count as the worst, null labels and ids are no labels; without labels of
both classes every score is 0; repeated rows and null ids are scored as they come; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from colscope.llm.common import decoded, id_and_text, map_rows, mix, save
from colscope.llm.ordered import running

PREFIXES = (3, 4, 5, 7)
ROWS, SIZE = 1 << 16, 16
WIDTHS, FILTERS, REGION = (1, 2, 3, 4), 8, 64
REACH = max(WIDTHS) - 1
#: Labelled documents that one task trains on, about, and labelled ids that are broadcast at most.
SHARD, FEW = 60_000, 8_000_000
EPOCHS, BATCH, RATE, FOLDS, ENOUGH, SEED = 6, 32, 0.01, 3, 12, 5
#: What the share of clean rows above a threshold costs against the share of toxic ones.
PRICE = 4.0
#: Regions that are looked at together, characters that are, about, and table rows that are averaged together.
RUN, STRETCH, CHUNK = 64, 1 << 18, 1024
#: Odd, so that it has an inverse: characters are digits to this base in the hash of a word.
BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def word_characters() -> np.ndarray:
    """Whether a code point stands in words."""
    found = np.zeros(sys.maxunicode + 1, bool)
    found[[match.start() for match in re.finditer(r"\w", "".join(map(chr, range(len(found)))))]] = True
    return found


@lru_cache(1)
def kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return made_powers(STRETCH)


def made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` and of its inverse, modulo 2**64."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        found.append(np.multiply.accumulate(powers))
    return found[0], found[1]


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts as numbers from 1 on, how many each text has, and the table rows of the numbers.

    The rows of a word are its own and those of its beginnings, all by one running polynomial hash of the characters.
    """
    texts = [text.lower() for text in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    word_characters().take(codes, out=inside[1:-1], mode="clip")
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    behind = np.cumsum([len(text) + 1 for text in texts])
    counts = np.diff(np.searchsorted(starts, behind), prepend=0)
    powers, inverse = kept_powers() if len(codes) <= STRETCH else made_powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=sums[1:])
    whole = (sums.take(ends) - sums.take(starts)) * inverse.take(starts)
    order = np.argsort(whole)
    new = np.diff(whole.take(order), prepend=np.uint64(0)) != 0
    new[:1] = True
    numbers = np.empty(len(whole), np.int64)
    numbers[order] = np.cumsum(new)
    first = order[new]
    whole, starts, ends = whole[first], starts[first], ends[first]
    begun = [(sums[np.minimum(starts + n, ends)] - sums[starts]) * inverse[starts] for n in PREFIXES]
    rows = [mix(key + np.uint64(n * BASE % (1 << 64))) % np.uint64(ROWS) for n, key in zip((0, *PREFIXES), (whole, *begun))]
    return numbers, counts, np.stack(rows, 1).astype(np.uint16)


def rows_of(word: str) -> tuple[int, ...]:
    """Rows of the embedding table for a word: its own first, then those of its beginnings."""
    return tuple(spelled([word])[2][0].tolist())


class Words:
    """Numbers for words that are given one by one, from 1 on; 0 is the space after a text."""

    def __init__(self) -> None:
        self.number: dict[str, int] = defaultdict(count(1).__next__)

    def of(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64)

    def rows(self) -> np.ndarray:
        return np.array([rows_of(word) for word in self.number], np.uint16).reshape(-1, 1 + len(PREFIXES))


@dataclass
class Batch:
    """Some texts: table rows of their words, their regions as numbers of words, and how many regions each text has."""

    rows: np.ndarray
    parts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], rows: np.ndarray) -> Batch:
        return cls.laid(np.concatenate([np.zeros(0, np.int64), *texts]), np.array([len(words) for words in texts], np.int64), rows)

    @classmethod
    def laid(cls, words: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> Batch:
        """Of all words in a row: rows of ``REGION`` words of one text, each with the ``REACH`` words after it."""
        sizes = -(-counts // REGION)
        padded = np.zeros((sizes.sum() + 1) * REGION + REACH, np.uint32)
        shift = (np.cumsum(sizes) - sizes) * REGION - (np.cumsum(counts) - counts)
        padded[np.arange(len(words)) + np.repeat(shift, counts)] = words
        parts = np.lib.stride_tricks.sliding_window_view(padded, REGION + REACH)[:-1:REGION].copy()
        parts[np.cumsum(sizes)[sizes > 0] - 1, REGION:] = 0  # behind a text is no word of the next
        return cls(rows, parts, sizes)

    def only(self, kept: np.ndarray) -> Batch:
        """Some of the texts, with their words alone."""
        if kept.all():
            return self
        parts = self.parts[np.repeat(kept, self.sizes)]
        used = np.zeros(len(self.rows) + 1, bool)
        used[0] = used[parts.ravel()] = True
        numbers = (np.cumsum(used) - 1).astype(np.uint32)
        return Batch(self.rows[used[1:]], numbers[parts], self.sizes[kept])

    @property
    def worded(self) -> np.ndarray:
        return np.flatnonzero(self.sizes)

    @property
    def starts(self) -> np.ndarray:
        """Where the regions of each worded text begin."""
        sizes = self.sizes[self.worded]
        return np.cumsum(sizes) - sizes

    def features(self, tops: np.ndarray) -> np.ndarray:
        """The largest and the mean of the maxima over the regions of each worded text."""
        largest, total = np.maximum.reduceat(tops, self.starts), np.add.reduceat(tops, self.starts)
        return np.concatenate([largest, total / self.sizes[self.worded, None]], 1)


@dataclass
class Network:
    """The parameters: embeddings, filters by width, and the logistic layer."""

    table: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.05, ROWS, SIZE), [draw(0.3, w, SIZE, FILTERS) for w in WIDTHS], draw(0.1, 2 * FILTERS * len(WIDTHS)), 0.0)

    def copy(self) -> Network:
        return Network(self.table.copy(), [w.copy() for w in self.filters], self.out.copy(), self.bias)

    def others(self) -> np.ndarray:
        """All parameters but the embeddings in one row."""
        return np.concatenate([*(w.ravel() for w in self.filters), self.out, [self.bias]]).astype(np.float32)

    def set_others(self, values: np.ndarray) -> None:
        for array in (*self.filters, self.out):
            array[...], values = values[: array.size].reshape(array.shape), values[array.size :]
        self.bias = float(values[0])

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Embeddings of words by number; number 0 is all zero."""
        found = np.zeros((len(rows) + 1, SIZE), self.table.dtype)
        for column in rows.T:
            found[1:] += self.table.take(column.astype(np.int64), 0, mode="clip")
        return found

    def placed(self) -> list[np.ndarray]:
        """For each place in a filter, what all filters hold there; zero for shorter ones."""
        blank = np.zeros((SIZE, FILTERS), self.table.dtype)
        return [np.concatenate([w[k] if k < len(w) else blank for w in self.filters], 1) for k in range(max(WIDTHS))]


def pooled(embedded: np.ndarray, placed: list[np.ndarray], parts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The maximum of each filter in each region and, on demand, the first place that has it. No filter begins behind a text."""
    weights, n, size = np.concatenate(placed), placed[0].shape[1], embedded.shape[1]
    tops, first = np.empty((len(parts), n), embedded.dtype), np.empty((len(parts) if places else 0, n), np.int64)
    for start in range(0, len(parts), RUN):
        words = parts[start : start + RUN]
        met = embedded.take(words.ravel().astype(np.int64), 0, mode="clip").reshape(len(words), -1)
        step = size * met.itemsize
        met = np.ndarray((len(words), REGION, len(weights)), met.dtype, met, 0, (met.strides[0], step, met.itemsize))  # each word with those after it
        found = (met.reshape(-1, len(weights)) @ weights).reshape(-1, REGION, n)
        last = np.flatnonzero(words[:, REGION - 1] == 0)
        found[last] = np.where(words[last, :REGION, None] == 0, -np.inf, found[last])
        halves = [found]
        while (half := halves[-1].shape[1] // 2) > 0:
            halves.append(np.maximum(halves[-1][:, :half], halves[-1][:, half:]))
        top = tops[start : start + RUN] = halves.pop()[:, 0]
        if places:
            first[start : start + RUN] = first_places(halves, top)
    return tops, first


def first_places(halves: list[np.ndarray], top: np.ndarray) -> np.ndarray:
    """The first place of each maximum, from the last pair of halves to the first: the front one, if it has the maximum."""
    n = top.shape[1]
    line, column = np.arange(len(top))[:, None], np.arange(n)
    place = np.zeros(top.shape, np.int64)
    for values in reversed(halves):
        front = values.ravel().take((line * values.shape[1] + place) * n + column, mode="clip")
        place += (front != top) * (values.shape[1] // 2)
    return place


def set_rows(array: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """``array[at] = values``, each row as one item."""
    item = np.dtype((np.void, array.itemsize * array.shape[1]))
    array.view(item)[:, 0][at] = values.view(item)[:, 0]


def added(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """``np.add.reduceat`` over rows; most groups are single rows."""
    found, sizes = values.take(firsts, 0, mode="clip"), np.diff(firsts, append=len(values))
    for k in (1, 2, 3):  # most of the rest are small
        some = np.flatnonzero((sizes > k) & (sizes <= 4))
        set_rows(found, some, found.take(some, 0, mode="clip") + values.take(firsts[some] + k, 0, mode="clip"))
    many = np.flatnonzero(sizes > 4)
    if len(many):
        sizes = sizes[many]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(firsts[many] - starts, sizes) + np.arange(sizes.sum())
        set_rows(found, many, np.add.reduceat(values.take(at, 0, mode="clip"), starts))
    return found


class Adam:
    """Steps of Adam for one array, or for some of its rows."""

    def __init__(self, array: np.ndarray) -> None:
        self.array, self.mean, self.square, self.count = array, np.zeros_like(array), np.zeros_like(array), 0

    def step(self, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        self.count += 1
        if at is None:
            self._step(gradient, self.mean, self.square, self.array)
        else:
            for start in range(0, len(at), CHUNK):
                some = at[start : start + CHUNK]
                new = [x.take(some, 0, mode="clip") for x in (self.mean, self.square, self.array)]
                self._step(gradient[start : start + CHUNK], *new)
                for array, values in zip((self.mean, self.square, self.array), new):
                    set_rows(array, some, values)

    def _step(self, gradient: np.ndarray, mean: np.ndarray, square: np.ndarray, values: np.ndarray) -> None:
        mean *= 0.9
        mean += 0.1 * gradient
        square *= 0.99
        square += 0.01 * gradient**2
        change = np.sqrt(square / (1 - 0.99**self.count))
        change += 1e-7
        values -= np.divide(RATE / (1 - 0.9**self.count) * mean, change, out=change)


def adams(net: Network) -> list[Adam]:
    return [Adam(x) for x in (net.table, *net.filters, net.out)]


def train(texts: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Network:
    """A network for texts given as numbers of words, whose table rows are in ``rows``: what ``fit`` does in one shard."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    weight = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum())) * len(labels)
    known = [k for k, words in enumerate(texts) if len(words)]
    for _ in range(EPOCHS):
        steps, order = adams(net), rng.permutation(known)
        for start in range(0, len(order), BATCH):
            _step(net, steps, [texts[k] for k in order[start : start + BATCH]], rows, labels[order[start : start + BATCH]], weight[order[start : start + BATCH]])
    return net


def _step(net: Network, steps: list[Adam], texts: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """One step for texts whose words are some of those in ``rows``."""
    numbers, words = np.unique(np.concatenate(texts), return_inverse=True)
    texts = np.split(words + 1, np.cumsum([len(words) for words in texts])[:-1])
    learn(net, steps, Batch.of(texts, rows[numbers - 1]), labels, weight)


def learn(net: Network, steps: list[Adam], batch: Batch, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One step along the gradient of the weighted log loss of a batch; returns the rows of the table that it touched."""
    kind = net.table.dtype
    worded, starts, parts = batch.worded, batch.starts, batch.parts
    sizes, labels, weight = batch.sizes[worded], labels[worded], weight[worded]
    if not len(worded):
        return worded
    embedded, filters = net.embedded(batch.rows), net.placed()
    tops, places = pooled(embedded, filters, parts, True)
    features = batch.features(tops)
    logit = features @ net.out + net.bias
    error = ((1 / (1 + np.exp(-logit)) - labels) * weight / len(worded)).astype(kind)
    # Back through the two poolings: the mean reaches all regions of a text, the maximum the first that has it.
    text = np.repeat(np.arange(len(worded)), sizes)
    n = tops.shape[1]
    reach = error[:, None] * net.out
    down = (reach[:, n:] / sizes[:, None])[text]
    at_top = tops == features[:, :n][text]
    at_top &= np.cumsum(at_top, 0) - (np.cumsum(at_top, 0) - at_top)[starts][text] == 1
    down += np.where(at_top, reach[:, :n][text], 0)
    column = np.arange(n)
    owns = [column[sum(width <= k for width in WIDTHS) * FILTERS :] for k in range(max(WIDTHS))]
    places += np.arange(len(parts))[:, None] * parts.shape[1]
    met = [parts.ravel().take(places[:, own[0] :] + k, mode="clip").astype(np.int64) for k, own in enumerate(owns)]
    hit = np.zeros(len(embedded), bool)  # only words at a maximum have a gradient
    for numbers in met:
        hit[numbers.ravel()] = True
    hit[0] = False
    index = np.cumsum(hit)
    index[~hit] = 0
    hit = np.flatnonzero(hit)
    embedded = np.concatenate([embedded[:1], embedded.take(hit, 0, mode="clip")])
    words = np.zeros_like(embedded)
    gradients = [np.zeros_like(weights) for weights in net.filters]
    for k, (own, numbers) in enumerate(zip(owns, met)):
        at = index[numbers] * len(own) + column[: len(own)]
        flow = np.bincount(at.ravel(), down[:, own[0] :].ravel(), len(embedded) * len(own)).reshape(-1, len(own)).astype(kind)
        words += flow @ filters[k][:, own[0] :].T
        gradient = embedded.T @ flow
        for w, width in enumerate(WIDTHS):
            if width > k:
                gradients[w][k] = gradient[:, own // FILTERS == w]
    # Rows of the table that a word uses take the gradient of the word.
    rows = batch.rows[hit - 1]
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    firsts = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
    touched = flat[order[firsts]].astype(np.int64)
    if len(touched):
        steps[0].step(added(words.take(1 + order // rows.shape[1], 0, mode="clip"), firsts), touched)
    for step, gradient in zip(steps[1:-1], gradients):
        step.step(gradient)
    steps[-1].step(features.T @ error + 1e-3 * net.out)
    net.bias -= RATE * float(error.sum())
    return touched


def logits(net: Network, rows: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """The logit of each text; wordless ones have the bias alone."""
    return batch_logits(net, Batch.of(texts, rows))


def batch_logits(net: Network, batch: Batch) -> np.ndarray:
    found = np.full(len(batch.sizes), net.bias, np.float64)
    if len(batch.worded):
        tops, _ = pooled(net.embedded(batch.rows), net.placed(), batch.parts)
        found[batch.worded] += batch.features(tops) @ net.out
    return found


@dataclass
class Committee:
    """The networks that left out one fold each. Every labelled document has taught all of them but one."""

    members: list[Network]

    @property
    def table(self) -> np.ndarray:
        """The embeddings of all members side by side."""
        return np.concatenate([net.table for net in self.members], 1)

    def logits(self, batch: Batch) -> np.ndarray:
        """The mean logit of the members."""
        return np.mean([batch_logits(net, batch) for net in self.members], 0)


class Languages:
    """Naive Bayes of words: the likeliest language of a text by the buckets of its words."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        counts = counts + 0.5
        self.logs = np.log(counts / counts.sum(0)).astype(np.float32)

    def guess(self, batch: Batch) -> list[str | None]:
        """None for a wordless text, or where no language is known."""
        found: list[str | None] = [None] * len(batch.sizes)
        if self.names and len(batch.worded):
            logs = np.concatenate([np.zeros((1, len(self.names)), np.float32), self.logs[batch.rows[:, 0]]]).T.copy()
            words = batch.parts[:, :REGION].astype(np.int64)
            sums = [np.add.reduceat(log.take(words, mode="clip").sum(1, dtype=np.float64), batch.starts) for log in logs]
            for k, best in zip(batch.worded.tolist(), np.argmax(sums, 0).tolist()):
                found[k] = self.names[best]
        return found


def threshold(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit that parts the two best: in the widest gap among those of most gain."""
    values = np.unique(np.concatenate([toxic, clean]))
    values = np.concatenate([[values[0] - 1], values, [values[-1] + 1]])
    share = lambda side: 1 - np.searchsorted(np.sort(side), values[1:]) / len(side)
    gain = share(toxic) - PRICE * share(clean)
    gap = np.where(gain >= gain.max() - 1e-12, np.diff(values), -1)
    at = int(gap.argmax())
    return float((values[at] + values[at + 1]) / 2)


def thresholds(logit: np.ndarray, toxic: np.ndarray, guessed: list[str | None]) -> dict[str | None, float]:
    """The threshold of each language, and that of all rows under None."""
    found = {None: threshold(logit[toxic], logit[~toxic])}
    guessed = np.array(guessed, object)
    for name in {x for x in guessed if x is not None}:
        here = guessed == name
        if min((here & toxic).sum(), (here & ~toxic).sum()) >= ENOUGH:
            found[name] = threshold(logit[here & toxic], logit[here & ~toxic])
    return found


@dataclass
class Model:
    """All that scoring needs: of fixed size but for the number of languages."""

    network: Committee
    languages: Languages
    thresholds: dict[str | None, float]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """The score and the guessed language of each text."""
        above, guessed = [np.zeros(0)], []
        for some in stretches(texts):
            batch = Batch.laid(*spelled(some))
            names = self.languages.guess(batch)
            above.append(self.network.logits(batch) - [self.thresholds.get(name, self.thresholds[None]) for name in names])
            guessed += names
        return 1 / (1 + np.exp(-np.concatenate(above))), guessed


def stretches(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of up to ``STRETCH`` characters; a longer text is a run of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) + 1 > STRETCH:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield some


BLOCKS = "shard int, rows binary, parts binary, sizes array<int>, folds array<int>, toxic array<boolean>, langs array<string>"


def block(shard: int, texts: list[str], toxic: list[bool], langs: list[str | None]) -> tuple:
    """A row of ``BLOCKS``. Equal texts share a fold."""
    folds = [xxhash.xxh3_64_intdigest(text) % FOLDS for text in texts]
    batch = Batch.laid(*spelled(texts))
    parts = batch.parts.astype(part_type(len(batch.rows)))
    return shard, batch.rows.tobytes(), parts.tobytes(), batch.sizes.tolist(), folds, toxic, langs


def part_type(words: int) -> type:
    return np.uint16 if words < 1 << 16 else np.uint32


def read_block(row: dict) -> Batch:
    rows = np.frombuffer(row["rows"], np.uint16).reshape(-1, 1 + len(PREFIXES))
    return Batch(rows, np.frombuffer(row["parts"], part_type(len(rows))).reshape(-1, REGION + REACH), np.array(row["sizes"], np.int64))


def arrow_rows(df: DataFrame, schema: str, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterable[list[tuple]]]) -> DataFrame:
    """Run ``rows_of`` over the Arrow batches of a partition; it yields lists of output tuples."""
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return df.mapInArrow(run, schema)


def training_blocks(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """All labelled documents of ``part`` as rows of ``BLOCKS``, a shard in each partition."""
    worst = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    worst = worst.agg((F.max("toxic") > 0).alias("toxic"))
    known = worst.count()
    shards = max(1, -(-known // SHARD))
    texts = docs.filter(part).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")
    )
    key = F.xxhash64(F.lit(SEED), "doc_id").alias("key")
    # Ids go to the texts while they fit; Spark takes them for larger than they are and would shuffle all texts.
    dealt = texts.join(F.broadcast(worst) if known <= FEW else worst, "doc_id").select(key, "toxic", "doc_id", "text", "lang")
    # Two partitions at least, one of them empty for a single shard: a union would join single ones to one task.
    dealt = dealt.withColumn("place", F.expr("key" if shards > 1 else "pmod(key, 1)")).repartition(max(2, shards), "place")
    one = dealt.groupBy("place", "key", "doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))  # repeated ids count once
    one = one.sortWithinPartitions("place", "key", "doc_id").select(F.col("x.text").cast("binary").alias("text"), "toxic", "x.lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        shard, waiting = TaskContext.get().partitionId(), []
        for batch in batches:
            for row in zip(*(batch[name] for name in ("text", "toxic", "lang"))):
                waiting.append([x.as_py() for x in row])
                if len(waiting) == BATCH:
                    yield [made(shard, waiting)]
                    waiting = []
        if waiting:
            yield [made(shard, waiting)]

    def made(shard: int, waiting: list[list]) -> tuple:
        texts, toxic, langs = zip(*waiting)
        return block(shard, [decoded(text) for text in texts], toxic, langs)

    return arrow_rows(one, BLOCKS, rows)


def counted_languages(blocks: DataFrame) -> Languages:
    """The naive Bayes model of all blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        counts = defaultdict(lambda: np.zeros(ROWS, np.int64))
        for batch in batches:
            for row in batch.select(["rows", "parts", "sizes", "langs"]).to_pylist():
                batch = read_block(row)
                ends = np.cumsum(batch.sizes)
                for lang, start, end in zip(row["langs"], ends - batch.sizes, ends):
                    words = batch.parts[start:end, :REGION].ravel()
                    if lang is not None:
                        here = counts[lang]
                        np.add.at(here, batch.rows[words[words > 0].astype(np.int64) - 1, 0], 1)
        for lang, found in counts.items():
            yield [(lang, -1, 0), *((lang, at, int(found[at])) for at in np.flatnonzero(found).tolist())]  # also if it has no word

    found = arrow_rows(blocks, "lang string, row int, n long", rows).groupBy("lang", "row").agg(F.sum("n").alias("n")).toArrow()
    lang = found["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist() if len(found) else []
    counts = np.zeros((ROWS + 1, len(names)))  # row -1 is the last one
    if names:
        counts[found["row"].to_numpy(), lang.indices.to_numpy()] = found["n"].to_numpy()
    order = sorted(range(len(names)), key=names.__getitem__)
    return Languages([names[k] for k in order], counts[:ROWS, order])


class Learner:
    """A network that takes steps in a task, and how often each row of its table was touched."""

    def __init__(self, net: Network) -> None:
        self.net, self.steps, self.touches, self.texts = net, adams(net), np.zeros(ROWS, np.int64), 0

    def learn(self, batch: Batch, labels: np.ndarray, weight: np.ndarray) -> None:
        self.touches[learn(self.net, self.steps, batch, labels, weight)] += 1
        self.texts += len(labels)

    def result(self) -> Iterator[tuple]:
        """``chunk, at, n, content``: touched rows with their counts, and all other parameters as chunk -1."""
        if self.texts:
            yield -1, bytes(8), np.array([self.texts]).tobytes(), self.net.others().tobytes()
        for chunk in range(0, ROWS, CHUNK):
            at = chunk + np.flatnonzero(self.touches[chunk : chunk + CHUNK])
            if len(at):
                yield chunk, at.tobytes(), self.touches[at].tobytes(), self.net.table[at].tobytes()


def trained_round(blocks: DataFrame, nets: list[Network], seen: list[set[int]], weights: list[tuple[float, float]], epoch: int) -> None:
    """One pass of each model over the blocks of its folds, in all shards side by side; their averages go to ``nets``.

    ``weights`` are those of a clean and a toxic document, by model.
    """
    parts = [blocks.withColumn("model", F.lit(k)) for k in range(len(nets))]
    shared = blocks.sparkSession.sparkContext.broadcast(nets)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        learners = {}
        for batch in batches:
            for k in np.random.default_rng((SEED, epoch)).permutation(batch.num_rows).tolist():
                row = batch.slice(k, 1).to_pylist()[0]
                key = model, _ = row["model"], row["shard"]
                if key not in learners:
                    learners[key] = Learner(shared.value[model].copy())
                kept = np.isin(row["folds"], sorted(seen[model]))
                toxic = np.array(row["toxic"], bool)[kept]
                learners[key].learn(read_block(row).only(kept), toxic, np.where(toxic, *weights[model][::-1]))
        for key, learner in learners.items():
            yield [(*key, *found) for found in learner.result()]

    trained = arrow_rows(reduce(DataFrame.union, parts), "model int, shard int, chunk int, at binary, n binary, content binary", rows)
    for row in trained.groupBy("model", "chunk").applyInArrow(averaged, "model int, chunk int, at binary, content binary").toArrow().to_pylist():
        net, at = nets[row["model"]], np.frombuffer(row["at"], np.int64)
        values = np.frombuffer(row["content"], np.float32).reshape(len(at), -1)
        if row["chunk"] < 0:
            net.set_others(values[0])
        else:
            net.table[at] = values
    shared.destroy()


def averaged(rows: pa.Table) -> pa.Table:
    """The mean of some parameters over the shards, weighted by ``n``."""
    rows = rows.sort_by("shard").to_pylist()
    total, weight = [], []
    at, place = np.unique(np.concatenate([np.frombuffer(row["at"], np.int64) for row in rows]), return_inverse=True)
    for row in rows:
        n, place_here, place = np.frombuffer(row["n"], np.int64)[:, None], *np.split(place, [len(row["at"]) // 8])
        values = n * np.frombuffer(row["content"], np.float32).reshape(len(n), -1).astype(np.float64)
        if not len(total):
            total, weight = np.zeros((len(at), values.shape[1])), np.zeros((len(at), 1))
        total[place_here] += values  # a shard has each row once
        weight[place_here] += n
    content = (total / weight).astype(np.float32)
    return pa.table({
        "model": pa.array([rows[0]["model"]], pa.int32()), "chunk": pa.array([rows[0]["chunk"]], pa.int32()),
        "at": [at.tobytes()], "content": [content.tobytes()],
    })


def unseen_logits(blocks: DataFrame, nets: list[Network], languages: Languages) -> DataFrame:
    """``name, logit, toxic`` of each training document: its guessed language, and its logit by the model that left out its fold."""
    shared = blocks.sparkSession.sparkContext.broadcast((nets, languages))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        nets, languages = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block, folds = read_block(row), np.array(row["folds"])
                found = np.zeros(len(folds))
                for fold in set(row["folds"]):
                    found[folds == fold] = batch_logits(nets[fold], block.only(folds == fold))
                yield list(zip(languages.guess(block), found.tolist(), row["toxic"]))

    return arrow_rows(blocks, "name string, logit double, toxic boolean", rows)


def spark_thresholds(scored: DataFrame) -> dict[str | None, float]:
    """``thresholds`` of a table of ``name, logit, toxic`` of any size: classes are counted along the logits of each language."""
    group = F.explode(F.array_compact(F.array(F.lit("*"), F.concat(F.lit("="), "name")))).alias("g")
    values = save(scored.select(group, "logit", "toxic").groupBy("g", "logit").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")
    ), "logits")
    ends = values.groupBy("g").agg(F.sum("t").alias("toxic"), F.sum("c").alias("clean"), F.max("logit").alias("last"))
    ends = ends.filter((F.col("g") == "*") | (F.least("toxic", "clean") >= ENOUGH))
    behind = ends.select("g", (F.col("last") + 1).alias("logit"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("c"))
    values = values.join(ends.select("g"), "g", "left_semi").union(behind).withColumn("one", F.lit(1).cast("long"))
    placed = running(values, "g", ["logit"], {"k": ("sum", "one"), "t_upto": ("sum", "t"), "c_upto": ("sum", "c")})
    # The gain of a threshold below this value, times the rows of both classes: whole numbers, so equal gains are equal.
    gain = F.expr("toxic - t_upto + t") * F.col("clean") - F.lit(PRICE) * F.expr("clean - c_upto + c") * F.col("toxic")
    placed = save(placed.join(ends, "g").select("g", "k", "logit", gain.cast("double").alias("gain")), "gains")
    best = placed.join(placed.groupBy("g").agg(F.max("gain").alias("gain")), ["g", "gain"])
    before = placed.select("g", (F.col("k") + 1).alias("k"), F.col("logit").alias("before"))
    gaps = best.join(before, ["g", "k"], "left").withColumn("before", F.expr("coalesce(before, logit - 1)"))
    widest = gaps.groupBy("g").agg(F.max(F.struct(F.expr("logit - before"), -F.col("k"), F.expr("(logit + before) / 2").alias("cut"))).alias("x"))
    return {None if r["g"] == "*" else r["g"][1:]: r["cut"] for r in widest.select("g", "x.cut").collect()}


def fit(docs: DataFrame, labels: DataFrame, part: str = "true") -> Model | None:
    """The model learned from all labelled rows of ``docs`` in ``part``; none without labels of both classes.

    The networks of the committee are trained side by side. Blocks are kept over the rounds.
    """
    kept = training_blocks(docs, labels, part).persist(StorageLevel.DISK_ONLY)
    blocks = kept.coalesce(max(1, kept.rdd.getNumPartitions()))  # of no known partitioning, so that a union keeps all partitions apart
    try:
        classes = np.zeros((FOLDS, 2), np.int64)
        rows = blocks.select(F.explode(F.arrays_zip("folds", "toxic")).alias("x")).groupBy("x.folds", "x.toxic").count()
        for fold, toxic, n in rows.collect():
            classes[fold, int(toxic)] = n
        if not classes.sum(0).all():
            return None
        seen = [set(range(FOLDS)) - {fold} for fold in range(FOLDS)]
        seen = [folds if classes[sorted(folds)].sum(0).all() else set(range(FOLDS)) for folds in seen]
        weights = [tuple(0.5 * classes[sorted(folds)].sum() / classes[sorted(folds)].sum(0)) for folds in seen]
        nets = [Network.new(np.random.default_rng(SEED)) for _ in seen]
        for epoch in range(EPOCHS):
            trained_round(blocks, nets, seen, weights, epoch)
        languages = counted_languages(blocks)
        return Model(Committee(nets), languages, spark_thresholds(unseen_logits(blocks, nets, languages)))
    finally:
        kept.unpersist()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted, lang_guess`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: dict) -> Iterable[tuple]:
        texts = [decoded(x) for x in batch["text"]]
        if shared.value is None:
            found, guessed = np.zeros(len(texts)), [None] * len(texts)
        else:
            found, guessed = shared.value.scores(texts)
        for doc_id, value, name in zip(batch["doc_id"], found.tolist(), guessed):
            yield doc_id, value, int(value >= 0.5), name

    return map_rows(id_and_text(docs), "doc_id long, score double, predicted int, lang_guess string", rows)
