"""The join against brute force over all pairs."""

import random
import re

import pytest

from gatecast.llm import ngram_join


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(sets[i]), d if not sets[i] else best.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one"), (905, "one"), (None, "one two")]
    doc = 0
    for size in (4, 9, 12, 20, 30, 60, 150, 400, 2000):
        for _ in range(4):
            base = [f"w{rng.randrange(300)}" for _ in range(size)]
            for share in (0, 0, 0.005, 0.02, 0.03, 0.05, 0.1):
                rows.append((doc, " ".join(edited(rng, base, share))))
                doc += 1
            chain = base
            for _ in range(4):
                chain = edited(rng, chain, 0.02)
                rows.append((doc, "\t".join(chain)))
                doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_equals_brute_force(spark, n, percent):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as n_shingles", "2 as node")
    got = [tuple(r) for r in ngram_join.ngram_components(docs, n, percent).collect()]
    assert sorted(got, key=str) == brute(rows, n, percent)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(400)] + [(1000 + i, f"other text {i} " * 9) for i in range(50)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {d: c for d, _, c in brute(rows, 3, 90)}
    assert sum(got[i] == 0 for i in range(400)) > 200


def test_sets_that_share_a_passage_only_are_not_read_again(spark, monkeypatch):
    rng, read, segments = random.Random(8), [], ngram_join._segments

    def counted(docs, nodes, n):
        read.append(nodes.count())
        return segments(docs, nodes, n)

    monkeypatch.setattr(ngram_join, "_segments", counted)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(40)] + [(100, passage), (101, passage + " end")]
    got = sorted(map(tuple, ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    assert got == brute(rows, 5, 80)
    assert sum(read) <= 6


def test_texts_are_not_shuffled_to_the_verdicts(spark):
    kept = ngram_join.keep_one_per_component(spark.createDataFrame([(3, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # marked by their number, not left to the planner's guess
    try:
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(docs).collect() == []
    assert ngram_join.keep_one_per_component(docs).collect() == []


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, text + " tail", "c"), (7, None, "d"), (8, "", None), (8, "", None), (None, text, "e"), (9, "quite other words here in this row", "f")]
    kept = ngram_join.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [1, 7, 8, 8, 9]
