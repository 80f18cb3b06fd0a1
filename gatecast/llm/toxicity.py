"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 5-grams (with word borders), hashed
into a fixed number of buckets, so an unseen misspelling or inflection shares
most of its vectors with a known word; whole words have no vector of their own,
which would draw weight from the shared ones.  The bags of a window
of words are averaged and go through a linear softmax; a document scores as
its most toxic window, so one insult in a long text is not averaged away.

Embeddings and softmax are trained jointly in numpy on a bounded sample of the
labelled rows; each step follows the window that scores highest.  Scoring
covers whole texts of all documents in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gatecast.llm import textops

BUCKETS = 1 << 17
DIM = 8
WINDOW = 16                   # words; windows overlap by half
SAMPLE_ROWS = 1600            # labelled rows of each label that are fitted, at most
SAMPLE_CHARS = 12 << 10       # of a longer text a piece of so many characters is fitted, drawn by its id
STEPS = 2000                  # of BATCH documents each, in whole passes over the sample
BATCH = 32
CHUNK_BYTES = 1 << 20         # texts worked on at once; the arrays take some 150 times that
THRESHOLD = 0.3
CLEAN_SCORE = 0.04
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_a:_b] = True


def word_features(t: textops.Texts, hasher: textops.Hasher):
    """Distinct words of the texts as bags of buckets.

    Returns the words' rows, the index of each word among the distinct ones,
    the distinct words' bags (flat buckets and offsets) and their hashes.  Words are runs
    of letters and digits (every byte above ASCII counts as one), lower-cased
    in A-Z, so punctuation at a word's end does not matter.
    """
    t = textops.lower_ascii(t)
    starts, ends, rows = textops.spans(t, _LETTER[t.data])
    h = hasher(t.data, starts, ends)
    _, first, index = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    # the distinct words side by side with a border byte before and after each
    size = e - s + 2
    offs = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(offs[-1], 32, np.uint8)
    inner = np.ones(offs[-1], bool)
    inner[offs[:-1]] = inner[offs[1:] - 1] = False
    if len(s):
        step = np.arange(int((e - s).sum())) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
        flat[inner] = t.data[np.repeat(s, e - s) + step]
    owner = np.repeat(np.arange(len(s)), size)
    # n-grams count characters, so they neither start nor end inside one
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    word_of = owner[lead]
    stop = np.append(lead[1:], len(flat))
    keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in (3, 4, 5):
        if len(lead) >= n:
            ok = np.flatnonzero(word_of[:len(lead) - n + 1] == word_of[n - 1:])
            keys.append(hasher(flat, lead[ok], stop[ok + n - 1]))
            own.append(word_of[ok])
    key, own = np.concatenate(keys), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    bags = (key[order] % np.uint64(BUCKETS)).astype(np.int32)
    return rows, index, bags, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(s)))]).astype(np.int64), h[first]


def sample_features(texts: list[str], hasher: textops.Hasher):
    """``word_features`` of many texts, made a MB at a time."""
    rows, index, hashes, sizes, bags, words = [], [], [], [], [], 0
    for t in textops.chunks(pa.array(texts, pa.large_string()), CHUNK_BYTES):
        r, i, b, o, h = word_features(t, hasher)
        rows.append((r + t.lo).astype(np.int32))
        index.append((i + words).astype(np.int32))
        hashes.append(h)
        sizes.append(np.diff(o))
        bags.append(b)
        words += len(h)
    _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    size, flat = np.concatenate(sizes), np.concatenate(bags)
    start, n = (np.cumsum(size) - size)[first], size[first]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate(rows), place.astype(np.int32)[np.concatenate(index)], flat[np.repeat(start, n) + step], np.concatenate([[0], np.cumsum(n)])


def window_bounds(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-overlapping word windows of every row: starts, ends, rows.  A row without words has none."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    half = WINDOW // 2
    n_win = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
    row = np.repeat(np.arange(n_rows), n_win)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    start = first[row] + k * half
    end = np.minimum(start + WINDOW, first[row] + count[row])
    return start, end, row


def fresh_words(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """1 for each word, 0 where the row had the same word less than a window before.

    A word that a text repeats over and over thus counts once in a window.
    """
    order = np.argsort(index, kind="stable")
    near = np.zeros(len(index), bool)
    a, b = order[:-1], order[1:]
    near[b] = (index[a] == index[b]) & (rows[a] == rows[b]) & (b - a < WINDOW)
    return (~near).astype(float)


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, a bias, and the score without words."""

    share: np.ndarray
    bias: float

    def scores(self, t: textops.Texts, hasher: textops.Hasher) -> np.ndarray:
        rows, index, bags, offs, _ = word_features(t, hasher)
        out = np.full(t.n, 1 / (1 + np.exp(-self.bias)))
        if not len(rows):
            return out
        each = np.add.reduceat(self.share[bags], offs[:-1]) / np.diff(offs)
        acc = np.concatenate([[0.0], np.cumsum(each[index] * fresh_words(rows, index))])
        start, end, row = window_bounds(rows, t.n)
        logit = (acc[end] - acc[start]) / (end - start) + self.bias
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[at]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, at), -30, 30)))
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Train embeddings and softmax jointly by Adagrad over the highest-scoring windows."""
    rng = np.random.default_rng(seed)
    if len(texts) == 0 or labels.min() == labels.max():
        rate = float(labels.mean()) if len(texts) else 0.0
        return Model(np.zeros(BUCKETS), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    hasher = textops.Hasher()
    rows, index, bags, offs = sample_features(texts, hasher)
    n_bag = np.diff(offs)
    fresh = fresh_words(rows, index)
    start, end, row = window_bounds(rows, len(texts))
    has = np.unique(row)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(row))
    y = labels[has].astype(float)
    # the first direction: log-odds of a document holding the bucket, per label
    present = np.zeros((2, BUCKETS))
    for d, (a, b) in enumerate(zip(at, last)):
        held = np.unique(index[start[a]:end[b - 1]])
        present[int(y[d]), np.unique(np.concatenate([bags[offs[w]:offs[w + 1]] for w in held]))] += 1
    n0, n1 = max((y == 0).sum(), 1), max((y == 1).sum(), 1)
    odds = np.log((present[1] + 0.5) / (n1 + 1)) - np.log((present[0] + 0.5) / (n0 + 1))
    out = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2))
    way = out[:, 1] - out[:, 0]
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)) + np.outer(odds * (present.sum(0) > 1), way) * (2.0 / (way @ way))
    bias = np.array([2.0, 0.0])
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-2), np.full(out.shape, 1e-2), np.full(2, 1e-2)
    for _ in range(-(-STEPS * BATCH // len(has)) if len(has) else 0):
        # the window of each document that scores highest now
        each = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[bags], offs[:-1]) / n_bag
        acc = np.concatenate([[0.0], np.cumsum(each[index] * fresh)])
        logit = (acc[end] - acc[start]) / (end - start)
        best = np.lexsort((-logit, row))[at]
        order = rng.permutation(len(has))
        for lo in range(0, len(has), BATCH):
            docs = order[lo:lo + BATCH]
            n_word = end[best[docs]] - start[best[docs]]
            doc_of_word = np.repeat(np.arange(len(docs)), n_word)
            place = np.repeat(start[best[docs]], n_word) + np.arange(len(doc_of_word)) - np.repeat(np.cumsum(n_word) - n_word, n_word)
            word = index[place]
            n_sub = n_bag[word]
            bag = bags[np.repeat(offs[word], n_sub) + np.arange(int(n_sub.sum())) - np.repeat(np.cumsum(n_sub) - n_sub, n_sub)]
            doc_of = np.repeat(doc_of_word, n_sub)
            weight = (fresh[place] / (n_sub * n_word[doc_of_word])).repeat(n_sub)
            hidden = np.zeros((len(docs), DIM))
            np.add.at(hidden, doc_of, weight[:, None] * emb[bag])
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs].astype(int)] -= 1
            u, inv = np.unique(bag, return_inverse=True)
            grad = np.zeros((len(u), DIM))
            np.add.at(grad, inv, weight[:, None] * (p @ out.T)[doc_of])
            d_out, d_bias = hidden.T @ p, p.sum(0)
            g_emb[u] += (grad ** 2).sum(1)
            emb[u] -= 0.5 * grad / np.sqrt(g_emb[u])[:, None]
            g_out += d_out ** 2
            out -= 0.05 * d_out / np.sqrt(g_out)
            g_bias += d_bias ** 2
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    # training parts the sample widely; words met later score less than known ones,
    # so the bias is raised until 1 % of the fitted clean texts reach CLEAN_SCORE
    model = Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))
    parts = textops.chunks(pa.array(texts, pa.large_string()), CHUNK_BYTES)
    clean = np.quantile(np.concatenate([model.scores(t, hasher) for t in parts])[labels == 0], 0.99)
    raised = np.log(CLEAN_SCORE / (1 - CLEAN_SCORE)) - np.log(clean / (1 - clean))
    return Model(model.share, model.bias + float(max(raised, 0.0)))


def training_sample(docs: DataFrame, labelled: DataFrame) -> list:
    """A bounded sample of labelled texts: per label, the first ids in the order of their hash.

    Ids are chosen on the label table alone; at most 2 * SAMPLE_ROWS texts then
    come to the driver.  Of a text over SAMPLE_CHARS characters a piece of that
    length comes, from a place drawn by the doc_id; no chosen row is left out for its length.
    """
    known = labelled.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for label in (0, 1)]
    text = F.col("text").cast("string")
    start = F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.char_length(text) - SAMPLE_CHARS + 1) + 1
    piece = F.when(F.char_length(text) > SAMPLE_CHARS, F.substring(text, start, SAMPLE_CHARS)).otherwise(text)
    rows = docs.where("text is not null").join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("doc_id", "toxic", piece.alias("text"))
    one = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["text"], r["toxic"]) for r in one.collect())


def score_documents(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the score from 0 to 1.

    Null and wordless texts get the score of the bias alone.  Texts are read whole.
    """
    name = "__tox_text"
    shared = docs.sparkSession.sparkContext.broadcast((model.share.astype(np.float32), model.bias))
    wide = docs.select(*docs.columns, F.col("text").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bias = shared.value
        local, hasher = Model(share, bias), textops.Hasher()
        for batch in batches:
            at = batch.schema.get_field_index(name)
            got = [local.scores(t, hasher) for t in textops.chunks(batch.column(at), CHUNK_BYTES)]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            names = [f for i, f in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*names, out])

    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    return wide.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a model on a bounded sample of ``labels(doc_id, toxic)`` and the texts of ``docs``.

    Rows of null or other labels are left out; a doc_id labelled twice counts
    with its larger label.  With no rows, or one label only, the model scores
    every text with that label's rate.
    """
    sample = training_sample(docs, labels)
    return fit([t for _, t, _ in sample], np.array([y for *_, y in sample], int))
