import random

import numpy as np

from gatecast.llm import toxicity

STEMS = ("grolmat", "snibbek", "vurzon")


def corpus(seed, n, tails):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdehilmnorstu") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.choice((5, 60, 900)))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(STEMS) + rng.choice(tails) + rng.choice(("", ".", ","))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_unseen_inflections_in_long_texts(spark):
    train = corpus(1, 900, ("", "o", "a", "er", "s"))
    test = [(10_000 + d, t, y) for d, t, y in corpus(2, 300, ("ion", "ut", "imo"))]
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t, _ in train + test], "doc_id long, text string, score double, source string")
    labels = spark.createDataFrame([(d, y) for d, _, y in train], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score_documents(docs, model, "p")
    assert out.columns == [*docs.columns, "p"]
    got = {r.doc_id: r.p for r in out.collect()}
    y = np.array([y for *_, y in test])
    p = np.array([got[d] for d, *_ in test])
    assert (p[y == 1] >= 0.3).mean() > 0.9
    assert (p[y == 0] >= 0.3).mean() < 0.02


def test_edge_rows(spark):
    train = corpus(1, 300, ("", "o"))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(d, t) for d, t, _ in train], schema)
    labels = spark.createDataFrame([(d, y) for d, _, y in train] + [(None, 1), (0, None), (99_999, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " ,;"), (4, "word " * 100_000), (4, "word " * 100_000), (None, "grolmat " + "fine " * 30), (6, "é" * 3000)], schema)
    out = toxicity.score_documents(odd, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    scores = [r.score for r in out]
    assert scores[0] == scores[1] == scores[2] and scores[3] == scores[4]
    assert scores[5] > 0.3
    flat = toxicity.train(docs, labels.where("false"))
    assert max(r.score for r in toxicity.score_documents(odd, flat).collect()) < 0.01
    only = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score_documents(odd, only).collect()) < 0.01
    assert toxicity.score_documents(spark.createDataFrame([], schema), model).collect() == []


def test_long_texts_are_fitted_too(spark):
    """Toxic texts that are all long: none is left out of the sample, a piece of each is fitted."""
    calm = "the river was calm and the boats lay still in the morning light "
    rude = "you are a worthless glorpish fool and everybody knows it "
    docs = spark.createDataFrame([(i, (rude if i % 2 else calm) * (600 if i % 2 else 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert len(sample) == 60 and max(len(t) for _, t, _ in sample) == toxicity.SAMPLE_CHARS
    assert all(t in rude * 600 for _, t, y in sample if y)
    model = toxicity.train(docs, labels)
    new = spark.createDataFrame([(1, "what a glorpish worthless fool"), (2, "boats in the calm morning")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(new, model).collect()}
    assert got[1] > toxicity.THRESHOLD > got[2]
