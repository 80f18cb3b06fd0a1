import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gatecast.llm import language_id as lid
from gatecast.llm import pieces, textops

SF = "/root/testdata/sf0.01/documents.parquet"


def test_forward_sums_all_segmentations():
    vocab = pieces.load_vocabulary()
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(len(vocab.piece_id) + 1), 2).T)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    of = {sp.id_to_piece(int(i)): k for k, i in enumerate(vocab.piece_id)}
    model = lid.Model(["a", "b"], logp, np.zeros(2))
    for text in ("the cat", "there", "été\n", "x" * 40, "日本 語"):
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        want = np.full((len(marked) + 1, 2), -np.inf)
        want[0] = 0
        for e in range(1, len(marked) + 1):
            for s in range(max(0, e - 16), e):
                k = of.get(marked[s:e], len(of) if e - s == 1 and vocab.dense[ord(marked[s])] == vocab.unknown else None)
                if k is not None:
                    want[e] = np.logaddexp(want[e], want[s] + logp[k])
        t = next(textops.chunks(pa.array([text])))
        units = pieces.cut_units(t, vocab, textops.Hasher())
        block = units.block(np.arange(len(units.hashes)))
        got = lid.Lattice(block, vocab).forward(logp)[block.first + block.size][units.index].sum(0)
        assert np.allclose(got, want[-1])
    assert len(lid.Predictor(model, vocab)(t)[0]) == 1


def test_expectation_maximisation_raises_the_likelihood():
    vocab = pieces.load_vocabulary()
    texts = ["the one and the other of them", "le un et le autre de les"] * 3
    langs = ["en", "fr"] * 3
    like = []
    for rounds in (0, 1, 3):
        lid.ROUNDS, old = rounds, lid.ROUNDS
        model = lid.fit(texts, langs, {"en": 3, "fr": 3}, vocab)
        lid.ROUNDS = old
        t = next(textops.chunks(pa.array(texts)))
        units = pieces.cut_units(t, vocab, textops.Hasher())
        block = units.block(np.arange(len(units.hashes)))
        sums = lid.Lattice(block, vocab).forward(model.logp)[block.first + block.size][units.index]
        like.append(sum(sums[units.rows % 2 == k, k].sum() for k in (0, 1)))
    assert like[0] < like[1] < like[2]
    assert math.isclose(np.exp(model.logp).sum(), 2, rel_tol=1e-6)


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet(SF)
    learn = docs.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in lid.predict(docs, learn).collect()}
    rows = pq.read_table(SF).to_pylist()
    held = [r for r in rows if r["doc_id"] % 2 and r["lang"] and r["text"]]
    assert len(got) == len(rows)
    assert sum(got[r["doc_id"]].lang_pred == r["lang"] for r in held) / len(held) > 0.97
    schema = "doc_id long, text string, lang string, letters int"
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 !!\n", "en", 1), (4, "x" * 50000, None, 1), (5, "the of and", None, 1),
                                 (5, "the of and", None, 1), (None, "le la les des", "fr", 1)], schema)
    out = lid.predict(odd, learn).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in out) == [("1", True), ("2", True), ("3", True), ("4", False), ("5", False), ("5", False), ("None", False)]
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in lid.predict(odd, odd.where("false")).collect()} == {"und"}
    assert lid.predict(spark.createDataFrame([], schema), learn).collect() == []


def test_a_language_of_long_texts_only_is_learnt(spark):
    long = "\u3053\u306e\u672c\u306f\u3068\u3066\u3082\u9762\u767d\u3044\u3067\u3059\u3002" * 400
    rows = [(i, "the one and the other of them", "en") for i in range(5)] + [(10 + i, long, "ja") for i in range(5)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, shares = lid.training_sample(learn)
    assert shares == {"en": 5, "ja": 5} and [x[1] for x in sample] == ["en"] * 5 + ["ja"] * 5
    assert all(x[2] in long and 8000 < len(x[2].encode()) < 8400 for x in sample[5:])
    assert len({x[2][:13] for x in sample[5:]}) > 1
    docs = spark.createDataFrame([(1, long), (2, long[:26]), (3, "one of the other")], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(lid.predict(docs, learn).collect())] == ["ja", "ja", "en"]
