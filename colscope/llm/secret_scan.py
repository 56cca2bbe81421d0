"""Secrets in texts: fixed patterns, and random strings told from identifiers by two Markov models.

The base finds assignments, access keys and hex runs by pattern. Outside their spans, every run of 5 or more
characters of ``ALPHABET`` is a candidate, also what a base span leaves of a run. Two order-1 Markov models over
these characters, one of random strings and one of ordinary identifiers, give the log-likelihood ratio
of the candidate; it is a secret if the ratio is at least ``LEAST`` in all and ``LEAST_EACH`` for each
character. The models are trained on labelled samples: random are the values that the base finds, and
``MADE`` strings drawn from a seeded generator so that small tables suffice; ordinary are
runs of 5 or more characters outside of base spans. Training reads the documents of about ``SAMPLE`` labelled ids
at most.

Spans count code points, end exclusive. Base spans always stay; spans of the models do not overlap them.

Defined cases: null text is empty and has no spans; texts of any length are searched whole; repeated
rows and null ids are returned as they come; without labels the models rest on the drawn strings;
an empty table gives an empty result; other columns are ignored, ``redact`` keeps them.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import decoded, id_and_text, map_rows, pieces, sampled_ids

KINDS = ("assign", "access", "hex", "random")
ALPHABET = string.ascii_letters + string.digits + "+/_-="
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGNED_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ANY_RUN = re.compile(r"[A-Za-z0-9+/_=-]{5,}")

#: Ids of labelled documents that the models are trained on, at most, and drawn random strings.
SAMPLE, MADE, SEED = 20_000, 3_000, 11
#: Log-likelihood ratio, in nats.
LEAST, LEAST_EACH = 10.0, 0.5

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, ordered by start and kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGNED_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    # Keys and hex runs of these lengths lie within one long run.
    for run in LONG_RUN.finditer(text):
        at, value = run.start(), run[0]
        if "AKIA" in value:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(value) if len(m[0]) >= 20]
        if len(value) >= 24:
            found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(value) if len(m[0]) >= 24]
    return sorted(found)


def spans(text: str, ratios: np.ndarray) -> list[Span]:
    """Base spans and those of the models."""
    base = base_spans(text)
    runs = list(ANY_RUN.finditer(without(text, base)))
    if not runs:
        return base
    totals = run_ratios([m[0] for m in runs], ratios)
    sizes = np.array([m.end() - m.start() for m in runs])
    random_runs = np.flatnonzero((totals >= LEAST) & (totals >= LEAST_EACH * sizes))
    return sorted([*base, *((runs[k].start(), 3, runs[k].end()) for k in random_runs)])


def without(text: str, found: list[Span]) -> str:
    """The text with spaces in place of spans."""
    parts, at = [], 0
    for start, _, end in found:
        if end > at:
            parts += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join([*parts, text[at:]])


def run_ratios(runs: list[str], ratios: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each string of ``ALPHABET``; row 0 of the table holds first characters."""
    codes = CODE[np.frombuffer("\x00".join([*runs, ""]).encode("ascii"), np.uint8)]
    steps = np.concatenate([[0], codes[:-1] + 1])
    starts = np.cumsum([0, *(len(x) + 1 for x in runs[:-1])])
    return np.add.reduceat(np.where(codes >= 0, ratios[steps, codes], 0.0), starts)


def text_of(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def count_steps(counts: np.ndarray, value: str) -> None:
    codes = CODE[np.frombuffer(value.encode("ascii", "ignore"), np.uint8)]
    codes = codes[codes >= 0]
    if len(codes):
        np.add.at(counts, (np.concatenate([[0], codes[:-1] + 1]), codes), 1)


def made_strings() -> Iterator[str]:
    """Random strings of the usual alphabets and lengths."""
    rng = random.Random(SEED)
    kinds = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef",
             string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "_-")
    for k in range(MADE):
        yield "".join(rng.choices(kinds[k % len(kinds)], k=rng.randrange(16, 49)))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios of the steps of the random and the ordinary model."""
    ids = sampled_ids(labels, SAMPLE, SEED)
    size = len(ALPHABET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size + 1, size), np.int64)
        for batch in batches:
            for text in map(decoded, batch["text"].to_pylist()):
                base = base_spans(text)
                for start, kind, end in base:
                    value = text[start:end]
                    count_steps(counts[0], ASSIGN.fullmatch(value)[1] if kind == 0 else value)
                runs = ANY_RUN.findall(without(text, base))
                codes = CODE[np.frombuffer("\x00".join([*runs, ""]).encode("ascii"), np.uint8)]
                steps = np.concatenate([[0], codes[:-1] + 1])
                np.add.at(counts[1], (steps[codes >= 0], codes[codes >= 0]), 1)
        where = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(counts.ravel()[where])], names=["step", "n"])

    sample = id_and_text(docs).join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    found = sample.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, size + 1, size))
    for step, n in found.collect():  # as many rows as the two tables have cells
        counts.ravel()[step] = n
    for value in made_strings():
        count_steps(counts[0], value)
    counts += 0.5
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def find(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_spans, spans`` for each row; spans as text."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            found = spans(decoded(text), table.value)
            base = [x for x in found if x[1] < 3]
            yield doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(3)), text_of(base), text_of(found)

    return map_rows(id_and_text(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string", rows)


def redacted(text: str, ratios: np.ndarray) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    parts, at = [], 0
    for start, kind, end in spans(text, ratios):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars``, if a column, follows where text changed."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                old = part["text"].to_pylist()
                new = [None if t is None else redacted(t, table.value) for t in old]
                columns = dict(zip(names, part.columns))
                columns["text"] = pa.array(new, part["text"].type)
                if "n_chars" in columns:
                    counted = [n if a == b else len(b) for n, a, b in zip(part["n_chars"].to_pylist(), old, new)]
                    columns["n_chars"] = pa.array(counted, part["n_chars"].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
