import random
import re
from collections import Counter

from gatecast.llm import quality

from .conftest import words

SCHEMA = "doc_id long, text string, score string"


def plain(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


def corpus():
    rng = random.Random(4)
    good = [f"wort{i}" for i in range(200)]
    rows, labels = [(9000, None, "s"), (9001, "", "s"), (9002, " \n\t ", "s"), (9003, "a b a b a b a b", "s"), (None, "no id", "s")], []
    for i in range(300):
        bad = i % 5 == 0
        w = [rng.choice(good) + ("&&&" if bad else "é" * (rng.random() < 0.1)) for _ in range(rng.randint(30, 200))]
        if i % 7 == 0:
            w = w[:20] * 5
        text = "".join(x + rng.choice((" ", " ", "  ", "\n", "\x0b")) for x in w)
        if i % 11 == 0:
            text = text + "\n" + text
        rows.append((i, text, "s"))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    rows.append((301, "wort1 " * 1 + " ".join(f"wort{i % 200}" for i in range(3000)), None))
    return rows, labels


def test_counts_equal_brute_force_and_verdict_follows_labels(spark):
    rows, labels = corpus()
    out = quality.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for d, t, _ in rows:
        r, want = got[d], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        if d is not None and d < 300 and not r.base_failed:
            assert r.kept == (d % 5 != 0), d


def test_without_labels_and_empty_table(spark):
    rows, _ = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality.judge(spark.createDataFrame(rows, SCHEMA), none).collect())
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_threshold():
    assert quality.threshold([(-10, 0, 5), (0, 4, 0)]) == -5 + 0
    assert quality.threshold([(3, 4, 0)]) < -10**9
    assert quality.threshold([]) < -10**9
