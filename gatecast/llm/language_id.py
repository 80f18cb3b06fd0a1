"""Language ID by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability.
The likelihood of a text is the sum over all its segmentations into pieces,
taken by a forward algorithm over the edges of piece occurrences.  As no piece
spans two units (see ``pieces``), the sum is the product over units, and each
distinct unit is summed once.

The probabilities are fitted by expectation-maximisation over all
segmentations, on a bounded sample of texts per language.  Prediction covers
whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm import pieces, textops
from gatecast.llm.pieces import Block, Seen, Vocabulary

SAMPLE_ROWS = 350              # texts that are fitted, per language, at most
SAMPLE_TEXT_BYTES = 8 << 10    # of a longer text a piece of about that size is fitted; it is predicted whole
MAX_LANGUAGES = 200            # more is an error: the model has pieces times languages
ROUNDS = 3
SMOOTH = 0.05                  # added to every piece's expected count
CHUNK_BYTES = 2 << 20
FIT_CHUNK_BYTES = 1 << 19      # texts fitted at once
CERTAIN = 40.0                 # log-odds beyond which the score is taken as 0 or 1


class Lattice:
    """Edges of a block in the order of their ends, in steps in which no two edges share an end."""

    def __init__(self, block: Block, vocab: Vocabulary) -> None:
        start, end, piece = pieces.find_edges(block.letters, vocab)
        odd = np.flatnonzero(block.letters == vocab.unknown)
        start, end = np.concatenate([start, odd]), np.concatenate([end, odd + 1])
        # characters that no piece covers share one more piece
        piece = np.concatenate([piece, np.full(len(odd), len(vocab.piece_id))])
        depth = end - block.first[block.owner()[start]]
        by = np.lexsort((end - start, depth))
        self.start, self.end, self.piece = start[by], end[by], piece[by]
        step = depth[by] * 32 + (self.end - self.start)
        cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])) if len(step) else np.zeros(0, np.int64)
        self.steps = list(zip(cut, np.append(cut[1:], len(step))))
        self.block = block

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed probability of every prefix: a row per place, a column per language."""
        b = self.block
        a = np.full((len(b.letters) + 1, logp.shape[1]), -np.inf)
        a[b.first] = 0
        for lo, hi in self.steps:
            e = self.end[lo:hi]
            a[e] = np.logaddexp(a[e], a[self.start[lo:hi]] + logp[self.piece[lo:hi]])
        return a

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations of the units, ``counts`` (unit, language) times each."""
        b = self.block
        a = self.forward(logp)
        z = a[b.first + b.size]
        back = np.full_like(a, -np.inf)
        back[b.first + b.size] = 0
        order = np.lexsort((self.end - self.start, -(self.start - b.first[b.owner()[self.start]])))
        s, e, p = self.start[order], self.end[order], self.piece[order]
        step = (s - b.first[b.owner()[s]]) * 32 + (e - s)
        cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        for lo, hi in zip(cut, np.append(cut[1:], len(step))):
            at = s[lo:hi]
            back[at] = np.logaddexp(back[at], back[e[lo:hi]] + logp[p[lo:hi]])
        unit = b.owner()[self.start]
        out = np.zeros(logp.shape)
        for k in range(logp.shape[1]):
            share = a[self.start, k] + logp[self.piece, k] + back[self.end, k] - z[unit, k]
            out[:, k] = np.bincount(self.piece, weights=np.exp(share) * counts[unit, k], minlength=len(out))
        return out


@dataclass
class Model:
    """Languages in order, log-probabilities (piece, language) and the log of the languages' shares."""

    languages: list
    logp: np.ndarray
    prior: np.ndarray


def fit(texts: list[str], langs: list[str], shares: dict, vocab: Vocabulary) -> Model:
    """Piece probabilities of each language by expectation-maximisation."""
    names = sorted(shares)
    n = len(vocab.piece_id) + 1
    logp = np.full((n, len(names)), -np.log(n))
    total = sum(shares.values())
    prior = np.log(np.array([shares[x] / total for x in names])) if names else np.zeros(0)
    if not texts:
        return Model(names, logp, prior)
    lang = np.array([names.index(x) for x in langs])
    width, hasher, lattices = len(names), textops.Hasher(), []
    for t in textops.chunks(pa.array(texts, pa.large_string()), FIT_CHUNK_BYTES):
        units = pieces.cut_units(t, vocab, hasher)
        if len(units.hashes):
            place = units.index * width + lang[units.rows + t.lo]
            counts = np.bincount(place, minlength=len(units.hashes) * width).reshape(-1, width).astype(float)
            lattices.append((Lattice(units.block(np.arange(len(units.hashes))), vocab), counts))
    if not lattices:
        return Model(names, logp, prior)
    for _ in range(ROUNDS):
        used = sum(x.expected(logp, c) for x, c in lattices) + SMOOTH
        logp = np.log(used) - np.log(used.sum(0))
    return Model(names, logp, prior)


class Predictor:
    def __init__(self, model: Model, vocab: Vocabulary) -> None:
        self.model, self.vocab, self.hasher = model, vocab, textops.Hasher()
        self._forget()

    def _forget(self) -> None:
        self.seen, self.sums = Seen(), np.zeros((0, len(self.model.languages)))

    def __call__(self, t: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each row and its posterior probability."""
        names = self.model.languages
        units = pieces.cut_units(t, self.vocab, self.hasher)
        total = np.tile(self.model.prior, (t.n, 1))
        if len(units.rows):
            if self.seen.full(len(units.hashes)):
                self._forget()
            place = self.seen.find(units.hashes)
            fresh = np.flatnonzero(place < 0)
            if len(fresh):
                block = units.block(fresh)
                sums = Lattice(block, self.vocab).forward(self.model.logp)[block.first + block.size]
                place[fresh] = self.seen.add(units.hashes[fresh])
                self.sums = np.concatenate([self.sums, sums])
            at = place[units.index]
            for k in range(len(names)):
                total[:, k] += np.bincount(units.rows, weights=self.sums[at, k], minlength=t.n)
        best = total.argmax(1)
        gap = np.clip(total - total[np.arange(t.n), best][:, None], -CERTAIN, 0)
        return best, 1 / np.exp(gap).sum(1)


def _fitted_piece() -> Column:
    """The text, or of a longer one the piece of about SAMPLE_TEXT_BYTES that starts at a place drawn by the id."""
    size, chars = F.octet_length("text"), F.char_length("text")
    n = F.ceil(chars * F.lit(SAMPLE_TEXT_BYTES) / size).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit("piece")), (chars - n + 1).cast("long")).cast("int") + 1
    return F.when(size <= SAMPLE_TEXT_BYTES, F.col("text")).otherwise(F.substr("text", start, n))


def training_sample(docs: DataFrame) -> tuple[list, dict]:
    """Texts and languages that are fitted, and the number of rows of each language.

    Per language the first ids in the order of their hash are taken; ids and
    languages are chosen without the texts, whatever their length.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not shares:
        return [], {}
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    picked = None
    for lang in sorted(shares):
        one = ids.where(F.col("lang") == lang).orderBy("h", "doc_id").limit(SAMPLE_ROWS).select("doc_id", "lang").distinct()
        picked = one if picked is None else picked.union(one)
    rows = (known.select("doc_id", "lang", _fitted_piece().alias("text"))
            .join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")))
    return sorted((r["doc_id"], r["lang"], r["text"]) for r in rows.collect()), shares


def predict(docs: DataFrame, learn: DataFrame, model_file: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """A row per row of ``docs(doc_id, text)``: doc_id, lang_pred and score.

    ``learn(doc_id, text, lang)`` is what is learnt from; rows with a null in
    it are left out.  A text that is null or has no letter, or any text if
    nothing was learnt, gets ``und`` and score 0.  The score is the posterior
    probability of the language.  Repeated rows each give a row; other columns
    are left aside; an empty table gives an empty result.
    """
    sample, shares = training_sample(learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                                                  F.col("text").cast("string").alias("text")))
    vocab = pieces.load_vocabulary(model_file)
    model = fit([x for *_, x in sample], [x for _, x, _ in sample], shares, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = shared.value
        predictor = Predictor(model, vocab) if model.languages else None
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for t in textops.chunks(batch.column("text"), CHUNK_BYTES):
                lang, score = np.full(t.n, "und", object), np.zeros(t.n)
                if predictor:
                    best, p = predictor(t)
                    has = letters[t.lo:t.hi]
                    lang[has], score[has] = np.array(model.languages, object)[best[has]], p[has]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[t.lo:t.hi], pa.array(lang, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
