"""Byte-level BPE against the tiktoken library, and back."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from filigree.llm import queries
from filigree.llm.byte_bpe import ByteBPE, decoded, encoded

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(FILE[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=FILE[1], mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.from_file(*FILE)


def ids(bpe, text):
    return bpe.encode([text])[0].tolist()


def test_random_texts(bpe, library):
    rng = random.Random(3)
    for letters in ("ab", "abcdefghij éßñ \n\t'stredlv", "日本語 ไทย 0123456789 .,!? \x1c\x85😀", "etaoin shrdlu"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
        found, counts = bpe.encode(texts)
        assert found.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
        assert counts.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_long_pre_tokens(bpe, library):
    rng = random.Random(5)
    for text in ("a" * 300_000, "ab" * 60_000, "".join(rng.choice("abcdefgh") for _ in range(200_000)), " " * 50_000, "é" * 40_000, "word " * 90_000):
        assert ids(bpe, text) == library.encode_ordinary(text)


def test_ties_go_left_and_lower_ranks_first():
    """A vocabulary whose merges make pairs of lower rank than the one at hand."""
    rng = random.Random(1)
    single = {bytes([k]): k for k in range(256)}
    for seed in range(60):
        own = random.Random(seed)
        made = list({bytes(own.choice(b"abc") for _ in range(own.randint(2, 5))) for _ in range(25)})
        own.shuffle(made)
        ranks = single | {t: 256 + k for k, t in enumerate(made)}
        ours, theirs = ByteBPE(ranks, r"[abc]+|\s+"), tiktoken.Encoding("own", pat_str=r"[abc]+|\s+", mergeable_ranks=ranks, special_tokens={})
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(6)) for _ in range(20)]
        assert ours.encode(texts)[0].tolist() == [i for t in texts for i in theirs.encode_ordinary(t)]


def test_what_is_remembered_changes_nothing(library):
    small = ByteBPE.from_file(*FILE, remembered=20)
    texts = ["the quick brown fox", "quick quick thefoxbrown", "", "the quick brown fox"] * 5
    for _ in range(3):
        assert small.encode(texts)[0].tolist() == [i for t in texts for i in library.encode_ordinary(t)]
        assert len(small.memo) <= 20


def test_decode(bpe):
    assert bpe.decode(None) is None and bpe.decode([]) == b""
    assert bpe.decode([1, None]) is None and bpe.decode([-1]) is None and bpe.decode([10**6]) is None


def test_columns_on_odd_rows(spark, library):
    texts = [None, "", " ", "one", "one", "x" * 50_000, "naïve <|endoftext|> 日本", "a  b\n\n c"]
    rows = [(k, t, "clash", 7) for k, t in enumerate(texts)] + [(None, "no id", None, None), (3, "one", "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, value int").repartition(3)
    out = docs.withColumn("ids", encoded(F.col("text"), *FILE, spark))
    out = out.withColumn("back", decoded(F.col("ids"), *FILE, spark)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]).decode() == (r["text"] or "")
    assert docs.filter("false").select(encoded(F.col("text"), *FILE, spark)).collect() == []


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        want = library.encode_ordinary(text)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
