"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of letters in lower case; word ends count as a space.
Learning sums the n-grams of all training texts of a language and keeps the ``PROFILE`` most frequent.
A text goes to the language whose profile is nearest: each n-gram of the text's own profile adds the
difference of its two ranks (out-of-place distance), or ``PROFILE`` where the language lacks it. The
score is one minus the share of the largest possible distance. Ties go to the smaller n-gram and name.

Defined cases: null text and text without letters give ``und`` and score 0, as does everything if
nothing could be learned; null languages and null ids are never learned from; null ids are predicted
with ``held_out`` false; texts of any length are read in pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import decoded, id_and_text, map_rows, pieces

PROFILE = 400
SPACE = 32
#: Characters that are read at once, and n-grams that a task holds before it passes its sums on.
PIECE, HELD = 1 << 18, 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, 21 bits a character, and how often each occurs."""
    sums, tail = [], np.array([SPACE], np.int64)
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(_letters()[points], points, SPACE).astype(np.int64)
        if start + PIECE >= len(text):
            codes = np.append(codes, SPACE)
        codes = np.concatenate([tail, codes])
        kept = np.ones(len(codes), bool)
        kept[len(tail) :] = (codes[len(tail) :] != SPACE) | (codes[len(tail) - 1 : -1] != SPACE)
        codes = codes[kept]
        new = len(tail)
        ones = codes[new:]
        twos = (codes[new - 1 : -1] << 21) | ones
        found = [ones[ones != SPACE], twos]
        if len(codes) > 2:
            middle = codes[1:-1]
            threes = ((codes[:-2] << 42) | (middle << 21) | codes[2:])[middle != SPACE]
            if new == 1:
                found.append(threes)
            else:
                found.append(((codes[new - 2 : -2] << 42) | (codes[new - 1 : -1] << 21) | ones)[codes[new - 1 : -1] != SPACE])
        sums.append(np.unique(np.concatenate(found), return_counts=True))
        tail = codes[-2:]
    return summed(sums)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by n-gram."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, owner = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, owner, np.concatenate([n for _, n in parts]))
    return keys, totals


def training_part(docs: DataFrame, remainder: int = 2, parts: int = 4) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts != remainder)


def learn(docs: DataFrame) -> DataFrame:
    """``lang, gram, rank``: the profile of each language over all texts of ``docs``."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                    found = grams(decoded(text))
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                    if size > HELD:
                        held = {k: [summed(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD // 2:
                            yield from emit(held)
                            held, size = {}, 0
        yield from emit(held)

    def emit(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, totals = summed(parts)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(totals)], schema=schema)

    lang = F.col("lang").cast("string").alias("lang")
    known = id_and_text(docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL"), lang)
    totals = known.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The limit stands on the number itself, so each task cuts its n-grams down to it before the shuffle.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = totals.withColumn("place", place).filter(F.col("place") <= PROFILE)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Profiles of all languages as one table of ranks."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        column = {lang: k for k, lang in enumerate(self.languages)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), column[lang]] = rank

    def predict(self, text: str) -> tuple[str, float]:
        keys, totals = grams(text)
        if not len(self.grams) or not (keys < 1 << 21).any():
            return "und", 0.0
        if len(keys) > PROFILE:
            cut = np.partition(totals, len(totals) - PROFILE)[len(totals) - PROFILE]
            keys, totals = keys[totals >= cut], totals[totals >= cut]
        own = keys[np.lexsort((keys, -totals))][:PROFILE]
        at = np.searchsorted(self.grams, own).clip(max=len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        away[ranks < 0] = PROFILE
        distance = away.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def identify(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score`` for each text. Profiles are ``PROFILE`` rows a language."""
    model = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()]))

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            yield doc_id, *model.value.predict(decoded(text))

    return map_rows(id_and_text(docs), "doc_id long, lang_pred string, score double", rows)


def held_out(remainder: int = 2, parts: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))
