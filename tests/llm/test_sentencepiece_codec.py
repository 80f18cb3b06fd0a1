import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from gatecast.llm import pieces, textops
from gatecast.llm import sentencepiece_codec as codec

ODD = ["", " ", "   ", "a  b\n\nc 😀x   ", " lead", "日本語のテキスト、です", "x" * 2000, "aaaaaaaaab" * 50, "<s> <0x0A> </s> <unk>", "▁▁x▁y▁ z",
       'The quick brown fox — 12345 foo_bar();\t\tint main() { printf("%d\\n"); }', "Καλημέρα κόσμε! Привет, мир. مرحبا", "naïve café Straße", "\x00\x01​",
       "ababababab abababa", "ththth the thethe hehe", "e" * 7 + " " * 33 + "e"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_ids_equal_the_library_and_round_trip(spark, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:400] + ODD + [None]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = codec.decode(codec.encode(docs, out="ids"), ids="ids", out="back")
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "back"]
    for r in out.collect():
        if r.text is None:
            assert r.ids is None and r.back is None
            continue
        assert r.ids == library.encode(r.text), r.text[:60]
        assert r.back == r.text.replace("▁", " "), r.text[:60]
    empty = codec.encode(docs.where("false"))
    assert empty.collect() == [] and codec.decode(empty).collect() == []


def test_units_met_again_and_a_full_cache_change_nothing(library):
    vocab = pieces.load_vocabulary()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    encoder = codec.Encoder(vocab)
    old, pieces.Seen.LIMIT = pieces.Seen.LIMIT, 3000
    try:
        for t in textops.chunks(pa.array(texts), 20_000):
            ids, counts = encoder(t)
            at = 0
            for text, n in zip(texts[t.lo:t.hi], counts):
                assert ids[at:at + n].tolist() == library.encode(text or "")
                at += n
    finally:
        pieces.Seen.LIMIT = old
