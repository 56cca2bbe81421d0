import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from colscope.llm.bpe import Codec, decode, encode, read_ranks
from colscope.llm.queries import QUERIES

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def both(name):
    with open(public_tokenizers.path(name), "rb") as file:
        ranks = read_ranks(file.read())
    own = Codec(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    codec, library = both(name)
    rng = random.Random(3)
    alphabets = ["ab", "aeinrst ", "0123456789 .", "".join(map(chr, range(32, 127))), "äöüßéè ñ ", " \n\t\r\x0b\x1c\x85 ​'st"]
    for k in range(3000):
        letters = rng.choice(alphabets) if k % 5 else "".join(chr(rng.randrange(0xD7FF)) for _ in range(9))
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_every_character():
    codec, library = both(FILES[0])
    for start in range(0, sys.maxunicode + 1, 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        ids = codec.encode(text)
        assert b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(text)) == ids, hex(start)


def test_long_words_take_linear_time():
    codec, library = both(FILES[0])
    rng = random.Random(1)
    for word in ("a" * 200_000, "".join(rng.choice("aeinrst") for _ in range(200_000)), " " * 50_000 + "x"):
        ids = codec.encode(word)
        assert codec.decode(ids) == word.encode()
        assert codec.encode(word[:3000]) == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(word[:3000]))


def test_query_and_odd_rows(spark, make_docs, sf):
    _, library = both(FILES[0])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op6_byte_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    docs = make_docs((1, None), (1, ""), (None, "word word"), (3, "x" * 300_000), (4, "<|endoftext|>")).withColumn("ids", F.lit(1))
    path = public_tokenizers.path(FILES[0])
    tokens = encode(docs, path, public_tokenizers.PATTERN)
    assert {(r["doc_id"], len(r["decoded"])) for r in tokens.collect()} == {(1, 0), (None, 9), (3, 300_000), (4, 13)}
    assert decode(tokens, path).filter("decoded = encode('word word', 'UTF-8')").count() == 1
    assert encode(make_docs(), path, public_tokenizers.PATTERN).count() == 0
