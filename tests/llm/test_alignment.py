import bisect
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colscope.llm import alignment
from colscope.llm.alignment import align, alignments, all_links, diagonal_groups, ends_of_groups, stretches
from colscope.llm.queries import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    """Encoders into (id, bytes) by the libraries that own the files."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    byte_of = {token: byte for byte, token in zip(range(256), _byte_characters())}

    def encode_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]

    def encode_b(text):
        return [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]

    return encode_a, encode_b


def _byte_characters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = itertools.count(256)
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


def brute_force(texts, libraries):
    """Rows of ``COLUMNS`` by ends that both sides share and by all overlaps."""
    rows, linked, per_text = [], Counter(), []
    for text in texts:
        a, b = (encode(text or "") for encode in libraries) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            per_text.append(None)
            continue
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        sides = []
        for side, e in zip((a, b), ends):
            cut = [0, *(bisect.bisect_right(e, high) for high in shared)]
            sides.append([",".join(str(i) for i, _ in side[x:y]) for x, y in zip(cut, cut[1:])])
        groups = list(map("|".join, zip(*sides)))
        links, j = [], 0
        for (i, x), end in zip(a, ends[0]):
            while j and ends[1][j - 1] > end - len(x):
                j -= 1
            while j < len(b) and ends[1][j] - len(b[j][1]) < end:
                if ends[1][j] > end - len(x):
                    links.append((i, b[j][0]))
                j += 1
        linked.update(set(links))
        per_text.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (i, _), n in linked.items():
        best[i] = max(best[i], n)
    for found in per_text:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            counts = [linked[x] for x in links]
            at_best = sum(n == best[i] for n, (i, _) in zip(counts, links))
            rows.append((n_a, n_b, len(groups), len(links), at_best, sum(counts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def by_id(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_groups_and_links_by_intersection(a, b):
    a, b = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    end = max(a[-1], b[-1])
    a, b = (side + [end] * (side[-1] < end) for side in (a, b))
    groups, links = diagonal_groups(a, b)
    to_a, to_b, straight = ends_of_groups(groups)
    shared = sorted(set(a) & set(b))
    assert [a[i - 1] for i in to_a] == shared and [b[j - 1] for j in to_b] == shared
    starts = [[0, *side[:-1]] for side in (a, b)]
    overlap = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]}
    found = list(zip(*(x.tolist() for x in all_links(to_a, to_b, straight, links))))
    assert len(found) == len(overlap) and set(found) == overlap


def test_long_one_to_one_stretches_are_one_row():
    ends = list(range(1, 100_001))
    groups, links = diagonal_groups([*ends, 100_005], [*ends, 100_002, 100_005])
    assert groups.tolist() == [[0, 0, 100_000, 0], [100_000, 100_000, 1, 2]] and links.tolist() == [[100_000, 100_000], [100_000, 100_001]]


def test_ids_are_those_of_the_libraries(libraries):
    pair = alignment.Pair(*(open(f, "rb").read() for f in FILES))
    rng = random.Random(5)
    pools = [range(32, 127), range(0xA0, 0x250), [10, 9, 13, 32, 39, 0x2009, 0], range(0x4E00, 0x4F00), range(0x1F300, 0x1F400)]
    for _ in range(1500):
        text = "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 40)))
        assert pair.a.encode_ordinary(" " + text) == [i for i, _ in libraries[0](text)]
    assert pair.a.encode_ordinary(" <|endoftext|>") == [i for i, _ in libraries[0]("<|endoftext|>")]


def test_parts_of_long_texts_change_nothing(libraries, monkeypatch):
    pair = alignment.Pair(*(open(f, "rb").read() for f in FILES))
    rng = random.Random(8)
    words = ["a", "don't", "x  y", "\n", " ", "\t", "naïve", "2024", "—", "words", "日本", "<s>", "''s", " "]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(40)]
    whole = [[x.tolist() if isinstance(x, np.ndarray) else x for x in row] for row in pair.aligned(texts)]
    monkeypatch.setattr(alignment, "STRETCH", 7)
    assert all("".join(stretches(t)) == t for t in texts) and max(len(stretches(t)) for t in texts) > 20
    parts = [[x.tolist() if isinstance(x, np.ndarray) else x for x in row] for row in pair.aligned(texts)]
    assert parts == whole


def test_table_by_brute_force(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    found = by_id(QUERIES["op12_token_alignment"](spark, sf))
    assert [found[r["doc_id"]] for r in docs] == brute_force([r["text"] for r in docs], libraries)
    assert max(x[4] for x in found.values()) > 100


def test_odd_rows(spark, make_docs, libraries):
    texts = [None, "", " ", "a", "a", "tabs\tand\r\nbreaks", "x ▁y", "<|endoftext|> <s> <0x41>", "日本語 ½ \x00 🙂", "  two  ", "é" * 900, "word " * 900]
    docs = make_docs(*texts).selectExpr("*", "'clash' AS pair", "'clash' AS row", "1 AS n", "2 AS n_a")
    found = by_id(alignments(docs, *FILES))
    assert [found[i] for i in range(len(texts))] == brute_force(texts, libraries)
    assert found[0] == found[1] == found[6] == (0, 0, 0, 0, 0, 0, "")
    twice = make_docs((None, "same words"), (7, "same words"), (7, "same words"))
    rows = alignments(twice, *FILES).collect()
    assert len(rows) == 3 and len({r["groups_sha256"] for r in rows}) == 1 and {r["count_sum"] for r in rows} == {rows[0]["n_links"] * 3}
    long = make_docs("word " * 400_000 + "end")
    row = alignments(long, *FILES).first()
    assert row["n_a"] == 400_001 and row["n_groups"] == 400_001 and row["count_sum"] == row["n_links"] == 400_001
    assert alignments(make_docs().filter(F.lit(False)), *FILES).count() == 0


def test_groups_as_text(make_docs, libraries):
    row = align(make_docs("tokenizers align"), *FILES).first()
    a, b = (encode("tokenizers align") for encode in libraries)
    assert (row["n_a"], row["n_b"]) == (len(a), len(b))
    sides = [x.split("|") for x in row["groups"].split(";")]
    assert [",".join(side) for side in zip(*sides)] == [",".join(str(i) for i, _ in side) for side in (a, b)]
    assert sum(row["times"]) == row["n_a"] + row["n_b"] - row["n_groups"]
