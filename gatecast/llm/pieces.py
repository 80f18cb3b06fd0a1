"""A fixed public piece vocabulary, and the occurrences of its pieces in a batch of texts.

Texts are seen as SentencePiece sees them: a space is the mark U+2581, and a
non-empty text gets one such mark in front.  They are cut wherever no piece
covers both neighbours; the parts ("units") are independent of each other, and
each distinct unit of a batch is worked on once.

Occurrences come from a suffix array over the concatenated distinct units: it
is sorted to the depth of the longest piece by rank doubling, and every piece
finds its range by binary search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gatecast.llm import textops

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CODE_POINTS = 0x110000
_BIGRAMS = 1 << 22


@dataclass
class Vocabulary:
    """Numpy tables of a SentencePiece model with byte fallback; a few MB, safe to broadcast."""

    dense: np.ndarray        # code point -> dense letter (1..), or the letter of unknown ones
    unknown: int
    bigram: np.ndarray       # hashed pairs of neighbouring letters inside pieces
    low: np.ndarray          # pieces, padded below and above, in four words of four letters
    high: np.ndarray
    piece_id: np.ndarray
    piece_len: np.ndarray
    rank: np.ndarray         # by id: order in which merges happen, -1 for single letters
    left: np.ndarray         # by id: the two halves of the last merge, -1 if none
    right: np.ndarray
    pair_keys: np.ndarray    # open addressing: (left, right) -> merged id
    pair_ids: np.ndarray
    byte_id: np.ndarray      # byte -> id
    text_bytes: np.ndarray   # bytes of every id, for decoding
    text_offs: np.ndarray

    def letter_hash(self) -> np.ndarray:
        """Well-mixed values of letters and of unknown code points; made once in each process."""
        if not hasattr(self, "_letter_hash"):
            self._letter_hash = textops.mix(np.arange(1, _CODE_POINTS + 70001, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return self._letter_hash

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_letter_hash"}


def _last_merges(pieces: dict, rank: dict) -> dict:
    """For each piece that merging its own letters yields: the halves of the last merge."""
    out = {}
    for piece in pieces:
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((rank[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in pieces), default=None)
            if best is None:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1:
            out[piece] = last
    return out


def _pack(rows: np.ndarray) -> np.ndarray:
    """Rows of 16 letters as four words, most significant first."""
    w = rows.astype(np.uint64).reshape(len(rows), 4, 4)
    return (w[..., 0] << np.uint64(48)) | (w[..., 1] << np.uint64(32)) | (w[..., 2] << np.uint64(16)) | w[..., 3]


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bigram_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint32) << np.uint32(16) | b) * np.uint32(2654435761)) >> np.uint32(10)


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read the model's pieces.  Pieces have at most 16 characters, each of them a piece itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
    pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
    letters = sorted({c for p in pieces for c in p})
    if max(map(len, pieces)) > 16 or len(letters) > 65000 or any(c not in pieces for c in letters):
        raise ValueError("pieces longer than 16 characters, or with characters that are no pieces, are not supported")
    dense = np.full(_CODE_POINTS, len(letters) + 1, np.uint16)
    for i, c in enumerate(letters):
        dense[ord(c)] = i + 1
    dense[0x20] = dense[ord(MARK)]
    rank_of = {p: -sp.get_score(i) for p, i in pieces.items()}
    by_rank = {p: k for k, p in enumerate(sorted((p for p in pieces if len(p) > 1), key=lambda p: (rank_of[p], pieces[p])))}
    merges = _last_merges(pieces, by_rank)
    rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for p, halves in merges.items():
        if halves:
            i = pieces[p]
            rank[i], left[i], right[i] = by_rank[p], pieces[halves[0]], pieces[halves[1]]
    usable = sorted(merges)
    flat = np.zeros((len(usable), 16), np.uint16)
    for k, p in enumerate(usable):
        flat[k, :len(p)] = [dense[ord(c)] for c in p]
    size = np.array([len(p) for p in usable])
    pad = np.arange(16)[None, :] >= size[:, None]
    bigram = np.zeros(_BIGRAMS, bool)
    inside = ~pad[:, 1:]
    bigram[_bigram_slot(flat[:, :-1][inside], flat[:, 1:][inside])] = True
    bits = 20
    keys, ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
    for p, i in pieces.items():
        for k in range(1, len(p)):
            a, b = pieces.get(p[:k]), pieces.get(p[k:])
            if a is not None and b is not None:
                key = (a << 32) | b
                at = int(_slot(np.array([key]), bits)[0])
                while keys[at] >= 0:
                    at = (at + 1) % len(keys)
                keys[at], ids[at] = key, i
    raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    byte_id = np.full(256, -1, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[raw[i][0]] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback")
    return Vocabulary(dense, len(letters) + 1, bigram, _pack(flat), _pack(np.where(pad, 0xFFFF, flat)),
                      np.array([pieces[p] for p in usable]), size, rank, left, right, keys, ids, byte_id,
                      np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))


@dataclass
class Block:
    """Distinct units side by side, each followed by a 0: what is matched at once."""

    letters: np.ndarray
    points: np.ndarray       # code points
    first: np.ndarray        # start of each unit
    size: np.ndarray

    def owner(self) -> np.ndarray:
        """The unit of every place in the block."""
        return np.repeat(np.arange(len(self.first)), self.size + 1)

    def by_depth(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of edges by their end's place within the unit, and the borders of each such place from 1 on."""
        depth = end - self.first[self.owner()[start]]
        most = int(depth.max(initial=0))
        return (np.argsort(depth.astype(np.uint16 if most < 65536 else np.int64), kind="stable"),
                np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=most + 1)[1:])]))


@dataclass
class Units:
    """The units of some texts."""

    rows: np.ndarray         # row of each unit, in text order
    index: np.ndarray        # its place among the distinct ones
    hashes: np.ndarray       # of the distinct ones
    starts: np.ndarray       # where each of those lies in the letters
    size: np.ndarray
    letters: np.ndarray
    points: np.ndarray

    def block(self, chosen: np.ndarray) -> Block:
        s, size = self.starts[chosen], self.size[chosen]
        first = np.cumsum(size + 1) - (size + 1)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        letters, points = np.zeros(int((size + 1).sum()), np.uint16), np.zeros(int((size + 1).sum()), np.uint32)
        letters[np.repeat(first, size) + step] = self.letters[np.repeat(s, size) + step]
        points[np.repeat(first, size) + step] = self.points[np.repeat(s, size) + step]
        return Block(letters, points, first, size)


class Seen:
    """Places of units worked on before in this task; emptied when full, so memory is bounded."""

    LIMIT = 500_000

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def full(self, more: int) -> bool:
        return len(self.keys) > 0 and len(self.keys) + more > self.LIMIT

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.places[at], -1)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        places = len(self.keys) + np.arange(len(hashes))
        keys, values = np.concatenate([self.keys, hashes]), np.concatenate([self.places, places])
        order = np.argsort(keys)
        self.keys, self.places = keys[order], values[order]
        return places


def cut_units(t: textops.Texts, vocab: Vocabulary, hasher: textops.Hasher) -> Units:
    points = np.frombuffer(t.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    offs = lead[t.offs]
    del lead
    full = np.diff(offs) > 0
    points = np.insert(points, offs[:-1][full], 0x20)       # the mark in front of a text
    offs = offs + np.concatenate([[0], np.cumsum(full)])
    letters = vocab.dense[points]
    m = len(letters)
    if not m:
        z = np.zeros(0, np.int64)
        return Units(z, z, z.astype(np.uint64), z, z, letters, points)
    new = np.ones(m, bool)
    new[1:] = ~vocab.bigram[_bigram_slot(letters[:-1], letters[1:])]
    new[offs[:-1][full]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], m)
    rows = np.searchsorted(offs, starts, "right") - 1
    code = np.where(letters == vocab.unknown, points + np.uint32(70000), letters)
    hashes = hasher.over(vocab.letter_hash()[code], starts, ends)
    index, at = textops.distinct(hashes)
    return Units(rows, index, hashes[at], starts[at], ends[at] - starts[at], letters, points)


def _suffix_array(words: np.ndarray, m: int) -> np.ndarray:
    """Order of the suffixes by their first 16 letters, from ranks of 4, 8 and 16."""
    rank = textops.ranks(words)
    for width in (4, 8):
        ahead = np.zeros(len(rank), np.uint64)
        ahead[:-width] = rank[width:]
        both = (rank << np.uint64(32)) | ahead
        if width == 4:
            rank = textops.ranks(both)
    return np.argsort(both[:m])


def find_edges(block: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every piece in the block: start, end and piece index."""
    m = len(block)
    wide = np.zeros(m + 16, np.uint64)
    wide[:m] = block
    words = np.zeros(m + 16, np.uint64)
    words[:m + 13] = ((wide[:m + 13] << np.uint64(48)) | (wide[1:m + 14] << np.uint64(32))
                      | (wide[2:m + 15] << np.uint64(16)) | wide[3:m + 16])
    order = _suffix_array(words, m)

    def below(keys: np.ndarray, equal: bool) -> np.ndarray:
        """Number of suffixes before each key (with ``equal``, up to it)."""
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), m, np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            less = np.full(len(open_), equal)
            for k in (3, 2, 1, 0):
                w, key = words[at + 4 * k], keys[open_, k]
                less = (w < key) | ((w == key) & less)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    a, b = below(vocab.low, False), below(vocab.high, True)
    count = np.maximum(b - a, 0)
    piece = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    start = order[a[piece] + step]
    return start, start + vocab.piece_len[piece], piece
