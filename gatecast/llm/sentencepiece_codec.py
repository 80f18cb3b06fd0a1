"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch are concatenated and indexed by a suffix array;
every piece finds its occurrences by binary search; the occurrences, sorted by
their place in a unit, are the edges of a graph over text positions.  Relaxing them from
left to right gives each position its last piece.

The model merges by rank (BPE), so an edge relaxes its end if its piece may
follow the last piece at its start: that is, if merging the two pieces'
letters would give just these two.  Exactly one edge into a position does, so
the path is the model's own segmentation, not one that merely fits.

Characters outside the vocabulary become byte pieces.  Decoding is exact,
save that U+2581 in a text is the model's mark for a space and comes back so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gatecast.llm import pieces, textops
from gatecast.llm.pieces import Block, Seen, Vocabulary

CHUNK_BYTES = 2 << 20  # texts matched at once; the arrays take some 100 times that

def merged_id(vocab: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id that two neighbouring pieces merge to, or -1."""
    key = (left << 32) | right
    at = pieces._slot(key, 20)
    out = np.full(len(key), -1, np.int64)
    todo = np.arange(len(key))
    while len(todo):
        found = vocab.pair_keys[at[todo]]
        hit = found == key[todo]
        out[todo[hit]] = vocab.pair_ids[at[todo[hit]]]
        todo = todo[~hit & (found >= 0)]
        at[todo] = (at[todo] + 1) & (len(vocab.pair_keys) - 1)
    return out


def may_follow(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the letters of ``a`` and ``b`` side by side yields just ``a`` and ``b``.

    Undo the merges of both in reverse order.  Between two of them the pieces
    x and y face each other at the border; had they a merge of smaller rank
    than the next own one, it would have come first.  Merges of equal rank
    happen from left to right.
    """
    ok = np.ones(len(a), bool)
    todo, x, y = np.arange(len(a)), a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(todo):
        m = merged_id(vocab, x, y)
        # a merge that its own letters never yield still happens here if its halves meet
        bad = (m >= 0) & (vocab.rank[m] < limit)
        ok[todo[bad]] = False
        rx, ry = vocab.rank[x], vocab.rank[y]
        go = ~bad & ((rx >= 0) | (ry >= 0))
        todo, x, y, rx, ry = todo[go], x[go], y[go], rx[go], ry[go]
        first = rx > ry
        limit = np.where(first, rx, ry + 1)
        x, y = np.where(first, vocab.right[x], x), np.where(first, y, vocab.left[y])
    return ok


def relax(units: Block, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the units, one after the other, and their numbers per unit.

    An id below 0 stands for the character ``-1 - id`` that no piece covers.
    """
    block = units.letters
    start, end, piece = pieces.find_edges(block, vocab)
    token = vocab.piece_id[piece]
    odd = np.flatnonzero(block == vocab.unknown)
    start, end = np.concatenate([start, odd]), np.concatenate([end, odd + 1])
    token = np.concatenate([token, -1 - units.points[odd].astype(np.int64)])
    by, bounds = units.by_depth(start, end)
    start, end, token = start[by], end[by], token[by]
    is_first = np.zeros(len(block) + 1, bool)
    is_first[units.first] = True
    fresh = is_first[start]
    last, back = np.zeros(len(block) + 1, np.int64), np.zeros(len(block) + 1, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        s, t = start[lo:hi], token[lo:hi]
        before = last[s]
        free = fresh[lo:hi] | (t < 0) | (before < 0)
        good = free.copy()
        check = np.flatnonzero(~free)
        good[check] = may_follow(vocab, before[check], t[check])
        e = end[lo:hi][good]
        last[e], back[e] = t[good], s[good]
    # walk back from every unit's end
    at = units.first + units.size
    alive = np.arange(len(at))
    got, owner = [], []
    while len(alive):
        got.append(last[at[alive]])
        owner.append(alive)
        at[alive] = back[at[alive]]
        alive = alive[at[alive] > units.first[alive]]
    counts = np.zeros(len(at), np.int64)
    for units_now in owner:
        counts[units_now] += 1
    stop = np.cumsum(counts)
    ids = np.zeros(int(counts.sum()), np.int64)
    for k, (units_now, tokens) in enumerate(zip(owner, got)):
        ids[stop[units_now] - 1 - k] = tokens
    return ids, counts


def with_bytes(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Write uncovered characters as byte pieces."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, counts
    raw = [chr(-1 - int(i)).encode() for i in ids[odd]]
    size = np.ones(len(ids), np.int64)
    size[odd] = [len(r) for r in raw]
    owner = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
    out = np.repeat(ids, size)
    at = np.repeat(np.cumsum(size)[odd] - size[odd], size[odd])
    out[at + np.concatenate([np.arange(n) for n in size[odd]])] = vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.bincount(owner, minlength=len(counts))


class Encoder:
    """Encodes texts chunk by chunk; a unit met again in the task is not matched again."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.hasher = vocab, textops.Hasher()
        self._forget()

    def _forget(self) -> None:
        self.seen, self.ids, self.counts = Seen(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, t: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their numbers per row."""
        units = pieces.cut_units(t, self.vocab, self.hasher)
        if not len(units.rows):
            return np.zeros(0, np.int32), np.zeros(t.n, np.int64)
        if self.seen.full(len(units.hashes)):
            self._forget()
        place = self.seen.find(units.hashes)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            ids, counts = with_bytes(*relax(units.block(fresh), self.vocab), self.vocab)
            place[fresh] = self.seen.add(units.hashes[fresh])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
        first = np.cumsum(self.counts) - self.counts
        at = place[units.index]
        n = self.counts[at]
        stop = np.cumsum(n)
        step = np.arange(int(stop[-1])) - np.repeat(stop - n, n)
        out = self.ids[np.repeat(first[at], n) + step]
        return out, np.bincount(units.rows, weights=n, minlength=t.n).astype(np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 text of each row of ids; the mark in front of a text is taken off."""
    ids = ids.astype(np.int64)
    size = np.diff(vocab.text_offs)[ids]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data = vocab.text_bytes[np.repeat(vocab.text_offs[ids], size) + step]
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64))
    raw = data.tobytes()
    out = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        out.append(raw[a + (b > a and raw[a] == 32):b])
    return out


def _extended(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(docs: DataFrame, model: str = pieces.DEFAULT_MODEL, text: str = "text", out: str = "token_ids") -> DataFrame:
    """All rows and columns of ``docs`` and the ids of the whole ``text`` as array<int>.

    A null text gives null, an empty one an empty array.  The vocabulary is
    read on the driver and broadcast; it is a few MB, whatever the data.  An
    empty table stays empty.  ``out`` must not be a column of ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces.load_vocabulary(model))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            col = batch.column(at)
            null = np.asarray(col.is_null())
            for t in textops.chunks(col, CHUNK_BYTES):
                ids, counts = encoder(t)
                offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(ids), mask=pa.array(null[t.lo:t.hi]))
                yield pa.RecordBatch.from_arrays([*(c[t.lo:t.hi] for c in batch.columns), lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, _extended(docs, out, ArrayType(IntegerType())))


def decode(df: DataFrame, model: str = pieces.DEFAULT_MODEL, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` and the text of the array ``ids``.

    Null gives null, an empty array an empty text.  Control pieces have no
    text; a null or unknown id is an error, and bytes that are no UTF-8 become
    U+FFFD.
    """
    shared = df.sparkSession.sparkContext.broadcast(pieces.load_vocabulary(model))
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                col = part.column(at)
                flat = col.flatten()
                if flat.null_count:
                    raise ValueError("an id is null")
                counts = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
                texts = decode_ids(flat.to_numpy(zero_copy_only=False), counts, vocab)
                null = np.asarray(col.is_null())
                value = pa.array([None if n else x.decode("utf-8", "replace") for x, n in zip(texts, null)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, value], names=[*part.schema.names, out])

    return df.mapInArrow(run, _extended(df, out, StringType()))
