import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatecast.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, most=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most=1, buckets=resampling.BUCKETS, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text, most)[1])
    t = Counter(bucket(f) for text in target for f in features(text, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, fs = features(text, most)
        w = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (s_all + buckets) / ((s[bucket(f)] + 1) * (t_all + buckets)))) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(fs), w, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def corpus():
    import random
    rng = random.Random(5)
    words = ["alpha", "Beta", "été", "naïve", "x", "42", "日本", "a b", "über-gut", "don't", "😀", "É"] + [f"w{i}" for i in range(60)]
    seps = [" ", "  ", "\n", "\t", ", ", ".", "\x00", "\x7f", "_", "[", "/"]
    return [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(0, 60)))) for i in range(300)]


@pytest.mark.parametrize("most, buckets", [(1, 10_000), (3, 97)])
def test_equals_brute_force(spark, most, buckets):
    docs = corpus() + [(None, "a b " * 15), (900, None), (901, ""), (902, "q" * 100_000 + " " + "z " * 30)] + [(7, "same words here " * 9)] * 25
    target = ["alpha w1 w2", "Über-gut w1", None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("clash"))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(d, t, max_words=most, buckets=buckets, percent=30)
    assert rows(got) == sorted(map(str, brute(docs, target, most, buckets, percent=30)))


def test_empty_tables(spark):
    d = spark.createDataFrame(corpus()[:40], "doc_id long, text string")
    none = d.where("false")
    assert resampling.resample(none, none).collect() == []
    assert rows(resampling.resample(d, none)) == sorted(map(str, brute(corpus()[:40], [])))


def test_dictionary_full_or_rebuilt_finds_the_same_words(monkeypatch):
    texts = [t for _, t in corpus()]
    for chars, rebuild in ((1_000_000, 50), (40, 10), (0, 0)):
        monkeypatch.setattr(resampling, "DICTIONARY_CHARS", chars)
        monkeypatch.setattr(resampling, "REBUILD_CHARS", rebuild)
        d = resampling.Dictionary()
        for text in texts:
            crcs, sizes = array("L"), array("q")
            n = d.scan(text.encode().translate(resampling._NORMAL).decode(), crcs, sizes)
            words = features(text)[0]
            assert n == len(words) and list(crcs) == [zlib.crc32(w.encode()) for w in words]
            assert list(sizes) == [len(w.encode()) for w in words]


def test_crc_of_concatenations():
    compose = resampling.Composer()
    parts = [(b"a", b""), (b"", b"xyz"), (b"hello ", b"world"), (b"\x00" * 9, bytes(range(256)) * 300)]
    crc = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    more = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    assert compose(crc, more, np.array([len(b) for _, b in parts])).tolist() == [zlib.crc32(a + b) for a, b in parts]
