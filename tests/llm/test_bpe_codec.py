import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatecast.llm import bpe_codec, textops

ODD = ["", " ", "   ", " a  b\n\n c\t\t", "it's we'll they've I'M 'lls ''ve '", "<|endoftext|>x<|endoftext|><|endoftext", "ab" * 700 + "abc" * 300,
       "a" * 1000, "e" * 7 + " " * 99 + "e", "日本語" * 100, "😀é" * 50, "  　x \x85", "x" * 63 + "y" * 65 + " z", "\x00\x01\x7f", "𝐀𝟙 ½²",
       "".join(random.Random(1).choice("abcdef") for _ in range(5000)), "ThisIsALongUnsplitTextWith" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_codec.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def encoder():
    return bpe_codec.Encoder(bpe_codec.Vocabulary())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def some_texts():
    return pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]


@pytest.mark.parametrize("segment", [1 << 18, 300])
def test_ids_equal_the_library_and_round_trip(spark, library, monkeypatch, segment):
    monkeypatch.setattr(bpe_codec, "SEGMENT_CHARS", segment)
    texts = some_texts() + ODD + [None] + ["many copies of a long text " * 40] * 20
    docs = spark.createDataFrame([(i if i % 7 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = bpe_codec.decode(bpe_codec.encode(docs, out="ids"), ids="ids", out="back")
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "back"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == ids_of(library, r.text or ""), (r.text or "")[:60]
        assert r.back == (r.text or "")
    empty = bpe_codec.encode(docs.where("false"))
    assert empty.collect() == [] and bpe_codec.decode(empty).collect() == []
    with pytest.raises(ValueError):
        bpe_codec.encode(docs, out="n_tokens")


def test_invalid_ids_are_errors(spark):
    for ids in ([1, None], [99_999_999], [-1]):
        with pytest.raises(Exception, match="an id is"):
            bpe_codec.decode(spark.createDataFrame([(ids,)], "token_ids array<int>")).collect()
    assert bpe_codec.decode(spark.createDataFrame([(None,), ([],)], "token_ids array<int>")).collect() == [(None, None), ([], "")]


def test_every_token_encodes_to_itself(encoder):
    """What makes joining exact: neighbours decide alone whether tokens are an encoding."""
    added = set(encoder.vocab.added.values())
    assert all(encoder._plain(raw) == [i] for i, raw in enumerate(encoder.vocab.bytes) if i not in added)


def test_segments_join_to_the_whole(encoder, library):
    rng = random.Random(2)
    for text in ODD + some_texts()[:60]:
        for _ in range(3):
            cuts = sorted({rng.randrange(len(text) + 1) for _ in range(rng.randrange(1, 9))} | {0, len(text)})
            parts = [encoder.segment(text[a:b]) for a, b in zip(cuts, cuts[1:])] or [encoder.segment("")]
            assert encoder.join_all(parts) == ids_of(library, text), (text[:60], cuts)
    bits = ["a", " ", "  ", "\n", "'", "ll", "'s", "<|endof", "text|>", "<|endoftext|>", "1", "!", "é", " x", "'re", "e" * 70]
    for _ in range(3000):
        a, b = ("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(2))
        got = encoder.join_segments(encoder.segment(a), encoder.segment(b))
        assert tuple(map(list, got)) == encoder.segment(a + b), (a, b)
        assert encoder.segment(a + b)[0] == ids_of(library, a + b)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "éà"])
def test_halves_of_one_split_join_to_the_whole(encoder, library, letters):
    rng = random.Random(len(letters))
    for n in (1, 2, 63, 64, 65, 200, 1500):
        text = "".join(rng.choice(letters) for _ in range(n))
        raw = text.encode()
        cut = rng.randrange(len(raw) + 1)
        want = ids_of(library, text)
        assert encoder.split_ids(raw) == want
        assert encoder.join(encoder.split_ids(raw[:cut]) if cut else [], encoder.split_ids(raw[cut:])) == want


def test_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_IDS", 500)
    encoder = bpe_codec.Encoder(bpe_codec.Vocabulary())
    texts = some_texts()[:80]
    for t in textops.chunks(pa.array(texts), 5_000):
        ids, counts = encoder.encode(t)
        ends = np.cumsum(counts)
        for text, a, b in zip(texts[t.lo:t.hi], ends - counts, ends):
            assert ids[a:b].tolist() == ids_of(library, text or "")


def test_classes_follow_the_library(encoder, library):
    split = library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x80, 0x600, 3), 0x2028, 0x3000, 0x1D400, 0x1F600, 0x10FFFF]:
        kind = chr(encoder.vocab.classes[c])
        together = [k for lead, k in (("a", "L"), ("1", "N"), ("!", "O")) if len(split(lead + chr(c))) == 1]
        assert kind == (together[0] if together else "\n"), hex(c)


def test_query_digests(spark, library):
    import hashlib

    from gatecast.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_bpe_codec"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(library, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
