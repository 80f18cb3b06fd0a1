r"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into a fixed number of buckets.  Two
multinomials are counted over all documents: the raw corpus, and the target,
which is the documents labelled as good.  A document's score is the mean, over
all its n-grams, of log p_target - log p_raw, so it does not grow with length.
Every document whose score reaches one threshold is kept.  The threshold comes
from exact counts of rounded scores of all labelled documents: the one with the
best balanced accuracy, in the middle if a range of them is as good.

Before that, plain rules fail documents that are short or repeat themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.llm import textops
from gatecast.llm.store import broadcast_ids, keep

BUCKETS = 1 << 16
STEP = 1000            # scores are compared in units of 1/STEP
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(n: int, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def base_counts(t: textops.Texts, hasher: textops.Hasher) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Plain counts of each row, and the hashes and rows of its words."""
    starts, ends, rows = textops.words(t)
    lead = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    h = hasher(t.data, starts, ends)
    # lines with a word, equal to an earlier one
    ls, le, lr = textops.lines(t)
    filled = np.searchsorted(starts, le, "left") > np.searchsorted(ends, ls, "right")
    ls, le, lr = ls[filled], le[filled], lr[filled]
    key = textops.mix(hasher(t.data, ls, le) + lr.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    dup_lines = _per_row(t.n, lr) - _per_row(t.n, lr[np.unique(key, return_index=True)[1]])
    # words inside 3-word windows that the row holds twice or more
    w, r, at = textops.windows(h, rows, t.n, 3, short=False)
    _, inverse, times = np.unique(textops.mix(w + r.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[again + k] = True
    counts = [_per_row(t.n, rows), _per_row(t.n, rows, lead[ends] - lead[starts]), symbol[t.offs[1:]] - symbol[t.offs[:-1]],
              dup_lines, _per_row(t.n, rows[inside])]
    return counts, h, rows


def ngram_buckets(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and their rows."""
    pairs, pair_rows, _ = textops.windows(h, rows, n, 2, short=False)
    one = textops.mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    return (np.concatenate([one, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([rows, pair_rows])


def _bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts per bucket over all rows and over the trusted ones; summed in Spark, two numbers per bucket come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, good = textops.Hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
            for t in textops.chunks(batch.column("text")):
                starts, ends, rows = textops.words(t)
                bucket, row = ngram_buckets(hasher(t.data, starts, ends), rows, t.n)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[trusted[t.lo:t.hi][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    parts = docs.select("text", "trusted").mapInArrow(run, "bucket bigint, raw bigint, good bigint")
    out = np.zeros((2, BUCKETS))
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        out[:, r["bucket"]] = r["raw"], r["good"]
    return out[0], out[1]


def threshold(steps: list[tuple[int, int, int]]) -> int:
    """The least kept unit, from ascending ``(unit, good rows, bad rows)``; with one kind of rows only, all are kept."""
    n_good, n_bad = sum(g for _, g, _ in steps), sum(b for *_, b in steps)
    if not n_good or not n_bad:
        return -(1 << 62)
    # cutting below a unit rejects all rows of the units before it
    best, lost_good, lost_bad, last = [], 0, 0, steps[0][0] - 1
    top = -1.0
    for unit, good, bad in [*steps, (steps[-1][0] + 1, 0, 0)]:
        worth = (n_good - lost_good) / n_good + lost_bad / n_bad
        if worth > top + 1e-12:
            top, best = worth, (last + 1, unit)
        lost_good, lost_bad, last = lost_good + good, lost_bad + bad, unit
    return (best[0] + best[1]) // 2


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Plain counts, score and verdict of every row of ``docs(doc_id, text)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept.  A null text has no words and
    fails.  A score without words is 0.  Trusted are documents with a label
    ``quality`` of 1 in ``labels(doc_id, quality)`` and none of 0; without any,
    or without any of 0, the plain rules alone decide.  Repeated rows count
    each.  Other columns are left aside; an empty table gives an empty result.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted")).where("trusted")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ids = good.select(F.col("doc_id").cast("long").alias("doc_id"), "trusted")
    ids = keep(ids, "trusted")
    marked = texts.join(broadcast_ids(ids), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    raw, target = _bucket_counts(marked)
    ratio = np.zeros(BUCKETS)
    if target.sum():
        ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = textops.Hasher(), shared.value
        for batch in batches:
            for t in textops.chunks(batch.column("text")):
                counts, h, rows = base_counts(t, hasher)
                bucket, row = ngram_buckets(h, rows, t.n)
                n = np.bincount(row, minlength=t.n)
                score = np.bincount(row, weights=table[bucket], minlength=t.n) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[t.lo:t.hi], *map(pa.array, counts), pa.array(score)], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    kinds = [*["bigint"] * 6, "double"]
    scored = keep(texts.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))
                  .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "scored")
    unit = F.round(F.col("score") * STEP).cast("long")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    steps = (scored.where("not base_failed").join(known, "doc_id").groupBy(unit.alias("unit"))
             .agg(F.sum("good").alias("good"), F.count("*").alias("n")).orderBy("unit").collect())
    passes = unit >= threshold([(r["unit"], r["good"], r["n"] - r["good"]) for r in steps])
    return scored.withColumn("kept", ~F.col("base_failed") & passes)
