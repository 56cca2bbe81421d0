"""Quality rules whose cutoffs are certified together on labelled documents.

Each rule has a score that is high for poor text and a fixed ladder of cutoffs from lenient to strict.
For every stratum the steps of all rules are put into one order, the path: parts of a ladder that reject
more poor than unlabelled texts come first, the rest is left out. At a position of the path a text is
rejected if any rule rejects it at the steps passed so far. Good texts do not shape the path, so they
can test it: the exact binomial test asks at each position whether the false rejection rate of all rules
together is at most ``risk``, and the path is followed while the test succeeds (fixed-sequence testing,
so the positions need no correction), at a level divided by the number of strata with good texts enough
to certify anything (Bonferroni). So with probability ``1 - miss`` every stratum rejects at most ``risk``
of its good texts. Of the certified positions the one that gains most is taken: share of poor texts
rejected minus ``price`` times the share of good ones; ties go to the lenient side. Without a gain, or
with too few labels, a stratum has no rules.

Good means quality 1 and not toxic, poor means quality 0; several labels of a document, or of copies of
one text, count as the worst, and equal texts of a stratum are one trial. Near copies still count as
independent. A null language is a stratum of its own.

Defined cases: null, empty and wordless texts have zero counts and fail the base; repeated rows are
judged alike; null ids are judged but never labelled; without labels only the base decides; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import id_and_text, map_rows, mix, save

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\r\x0b\x0c"
TRAILING = bytes(range(0x80, 0xC0))
UPPER = bytes(range(ord("A"), ord("Z") + 1))


STEPS = 60


def ladder(lenient: float, strict: float, steps: int = STEPS) -> tuple[float, ...]:
    """Cutoffs in equal ratios."""
    return tuple(lenient * (strict / lenient) ** (k / (steps - 1)) for k in range(steps))


#: Score and ladder of each rule. A document is rejected where its score exceeds the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / nullif(word_chars, 0)", ladder(0.5, 0.001)),
    "marks": ("n_marks / nullif(word_chars, 0)", ladder(0.5, 0.001)),
    "capitals": ("n_capitals / nullif(word_chars, 0)", ladder(0.95, 0.05)),
    "copied_lines": ("n_dup_lines / nullif(n_lines, 0)", ladder(0.95, 0.02)),
    "repeated_words": ("n_repeat_words / nullif(n_words, 0)", ladder(0.95, 0.01)),
    "long_words": ("word_chars / nullif(n_words, 0)", ladder(60, 5)),
    "short_words": ("n_words / nullif(word_chars, 0)", ladder(0.95, 0.15)),
}


@dataclass(frozen=True)
class Risk:
    """False rejection rate per stratum, chance that any bound fails, price of a good document."""

    risk: float = 0.01
    miss: float = 0.05
    price: float = 20.0


def measure(text: bytes | None) -> tuple[int, ...]:
    """Counts of a text: words, their code points, symbols, copied lines, repeated words, and more."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda some: len(text) - len(text.translate(None, some))
    return (
        len(words), len(text.translate(None, BLANK + TRAILING)), without(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), without(b"!?"), without(UPPER),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = mix(windows * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= starts
    return int(covered.sum())


def at_most(x: int, n: int, rate: float) -> float:
    """P(X <= x) for a binomial X of n trials at this rate; exact but for rounding."""
    if x >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1)
    term = total = math.exp(log_term + x * math.log(rate) + (n - x) * math.log1p(-rate))
    for i in range(x, 0, -1):
        term *= i / (n - i + 1) * (1 - rate) / rate
        total += term
        if term < 1e-17 * total and i < n * rate:
            break
    return min(1.0, total)


NEVER = 2**31 - 1
UNLABELLED, GOOD, POOR = 0, 1, 2


def path_of(poor: list[list[int]], other: list[list[int]]) -> list[list[int]]:
    """The position of each step of each ladder on the path of a stratum, ``NEVER`` where left out.

    ``poor[rule][k]`` and ``other[rule][k]`` count the poor and the unlabelled texts that step k is the
    first to reject. Neighbouring steps join while a later part rejects poor texts at a better price.
    """
    n_poor, n_other = (max(map(sum, some), default=0) for some in (poor, other))

    def worth(part: list[int]) -> float:
        return part[2] / max(n_poor, 1) * (n_other + 1) / (part[3] + 1)

    parts = []
    for rule, (p, u) in enumerate(zip(poor, other)):
        own: list[list[int]] = []
        for k in range(STEPS):
            own.append([k, k + 1, p[k], u[k]])
            while len(own) > 1 and worth(own[-1]) >= worth(own[-2]):
                last = own.pop()
                own[-1] = [own[-1][0], last[1], own[-1][2] + last[2], own[-1][3] + last[3]]
        parts += [(-worth(x), rule, x[0], x[1]) for x in own if worth(x) > 1]
    positions = [[NEVER] * (STEPS + 1) for _ in poor]
    passed = 0
    for _, rule, start, end in sorted(parts):
        for k in range(start, end):
            positions[rule][k] = passed
            passed += 1
    return positions


def best_position(good: dict[int, int], poor: dict[int, int], level: float, risk: Risk) -> int | None:
    """The certified position of most gain; texts are counted by the position that rejects them first."""
    n_good, n_poor = sum(good.values()), sum(poor.values())
    best, most, wrong, right = None, 0.0, 0, 0
    for position in sorted((good.keys() | poor.keys()) - {NEVER}):
        wrong += good.get(position, 0)
        right += poor.get(position, 0)
        if not n_good or at_most(wrong, n_good, risk.risk) > level:
            break
        gain = (right / n_poor if n_poor else 0.0) - risk.price * wrong / n_good
        if gain > most:
            best, most = position, gain
    return best


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``stratum`` (the language), ``text_hash`` and the counts of every text."""

    def rows(batch: dict) -> Iterable[tuple]:
        for doc_id, lang, text in zip(batch["doc_id"], batch["stratum"], batch["text"]):
            yield doc_id, lang, xxhash.xxh3_128_digest(text or b""), *measure(text)

    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("none")).alias("stratum")
    return map_rows(id_and_text(docs, stratum), "doc_id long, stratum string, text_hash binary, " + ", ".join(f"{c} long" for c in COUNTS), rows)


def cutoffs_of(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``stratum, rule, cutoff``: the certified cutoffs."""
    worst = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    side = F.when(F.col("quality") == 0, POOR).when((F.col("quality") == 1) & (F.col("toxic") == 0), GOOD)
    steps = F.array(*[_first_step(score, cutoffs) for score, cutoffs in RULES.values()])
    judged = measured.filter(~base_failed()).join(worst.select("doc_id", side.alias("side")), "doc_id", "left")
    texts = judged.groupBy("stratum", "text_hash").agg(
        F.max(F.coalesce("side", F.lit(UNLABELLED))).alias("side"), F.first(steps).alias("steps")
    )
    texts = save(texts.drop("text_hash"), "steps")

    bins = texts.filter(F.col("side") != GOOD).select("stratum", "side", F.posexplode("steps").alias("rule", "step"))
    bins = bins.groupBy("stratum", "side", "rule", "step").agg(F.count("*").alias("n"))
    guides = bins.groupBy("stratum").agg(F.collect_list(F.struct("side", "rule", "step", "n")).alias("bins"))

    def paths(batch: dict) -> Iterable[tuple]:
        for stratum, found in zip(batch["stratum"], batch["bins"]):
            split = {s: [[0] * (STEPS + 1) for _ in RULES] for s in (POOR, UNLABELLED)}
            for x in found:
                split[x["side"]][x["rule"]][x["step"]] += x["n"]
            yield stratum, [k for ladder in path_of(split[POOR], split[UNLABELLED]) for k in ladder]

    known = save(map_rows(guides, "stratum string, path array<int>", paths), "paths")
    first = F.expr(f"array_min(transform(steps, (s, i) -> path[i * {STEPS + 1} + s]))")
    placed = texts.filter(F.col("side") != UNLABELLED).join(known, "stratum").groupBy(
        "stratum", "side", first.alias("position")
    ).agg(F.count("*").alias("n"))
    trials = placed.groupBy("stratum").agg(
        F.collect_list(F.struct("side", "position", "n")).alias("bins"),
        F.sum(F.when(F.col("side") == GOOD, F.col("n")).otherwise(0)).alias("n_good"),
    ).filter(F.pow(F.lit(1 - risk.risk), F.col("n_good")) <= risk.miss)
    level = risk.miss / max(1, trials.count())

    def rows(batch: dict) -> Iterable[tuple]:
        for stratum, found, path in zip(batch["stratum"], batch["bins"], batch["path"]):
            good, poor = ({x["position"]: x["n"] for x in found if x["side"] == s} for s in (GOOD, POOR))
            best = best_position(good, poor, level, risk)
            if best is not None:
                for i, (rule, (_, cutoffs)) in enumerate(RULES.items()):
                    taken = [k for k in range(STEPS) if path[i * (STEPS + 1) + k] <= best]
                    if taken:
                        yield stratum, rule, cutoffs[taken[-1]]

    return map_rows(trials.join(known, "stratum").select("stratum", "bins", "path"), "stratum string, rule string, cutoff double", rows)


def _first_step(score: str, cutoffs: tuple[float, ...]):
    """The first step of a falling ladder that a score exceeds, or the length of the ladder."""
    return F.expr(f"CAST(size(filter(array({', '.join(f'{c!r}D' for c in cutoffs)}), c -> NOT coalesce({score} > c, false))) AS INT)")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Counts, ``base_failed``, the names of the ``failed_rules`` and ``kept`` for each document."""
    measured = save(counts(docs), "counts")
    certified = cutoffs_of(measured, labels, risk)
    limits = certified.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    judged = measured.join(save(limits, "limits"), "stratum", "left").withColumn("base_failed", base_failed())
    failed = F.array_compact(F.array(*[
        F.when(F.expr(f"{score} > limits['{name}']"), F.lit(name)) for name, (score, _) in RULES.items()
    ]))
    return (
        judged.withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("limits", "text_hash")
    )
