"""Byte-level BPE encoding and decoding by tree concatenation.

A text is split by the tokenizer's pattern, and each split's tokens come from
merging its bytes by rank.  A long stretch is never encoded in one go.  Its
halves are encoded independently, and joined: a window of tokens around the
joint is decoded to bytes and encoded again, and grows on either side until the
new tokens begin with the left half's token and end with the right half's one.

That is exact.  Tokens that merge by rank are the encoding of their bytes if
and only if every two neighbours are the encoding of theirs.  All neighbours
in a half are; those inside the window are; and where both sides agree the
window's outermost pairs are pairs of the halves.

The same is done at two levels.  Inside a split, leaves of some bytes are joined
in a tree.  Whole texts over some size are cut into segments that Spark spreads
over tasks; the segments' results meet in a tree again, where the pattern is
run anew around each joint until its borders agree with those of the right part.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gatecast.llm import textops
from gatecast.llm.pieces import Seen
from gatecast.llm.store import keep

DEFAULT_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
LEAF = 64                 # bytes merged in one go
SEGMENT_CHARS = 1 << 18   # longer texts are spread over tasks
CACHE_IDS = 4_000_000     # ids of the distinct splits that a task remembers
MATRIX_CELLS = 1 << 20    # ids merged at once
NO_MERGE = np.iinfo(np.int32).max
CHUNK_BYTES = 2 << 20

# One byte per character: those of the contractions themselves, else the class.
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[Lstrevmld]+| ?N+| ?[O']+|[ \n]+(?![^ \n])|[ \n]+")
_OWN = "strevmld' "


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and that byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def _classes(tokenizer) -> np.ndarray:
    """The class of every code point (L letter, N number, O other, newline for space), as the tokenizer's own pattern sees it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20]
    text = "".join(map(chr, points))
    out = np.full(0x110000, ord("O"), np.uint8)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for _, (a, b) in split(text):  # every piece has one class
        c = text[a]
        kind = next((k for lead, k in (("a", "L"), ("1", "N"), ("!", "O")) if len(split(lead + c)) == 1), "\n")
        out[points[a]:points[b - 1] + 1] = ord(kind)
    for c in _OWN:
        out[ord(c)] = ord(c)
    return out


class Vocabulary:
    """Tables of a byte-level BPE tokenizer; a few MB, safe to broadcast."""

    def __init__(self, path: str = DEFAULT_MODEL) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
        kind = spec.get("pre_tokenizer") or {}
        if (spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True)
                or any(model.get(k) not in (v, None, False) for k, v in plain.items())):
            raise ValueError("only plain byte-level BPE tokenizers are supported")
        ids = model["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.bytes = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = raw(token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.byte_id = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}  # (left, right) -> (rank, merged)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.merged = np.array([new for _, new in self.merges.values()], np.int32)  # by rank
        self.bits = len(self.merges).bit_length() + 2
        self.pair_keys = np.full(1 << self.bits, -1, np.int64)  # open addressing: left << 32 | right -> rank
        self.pair_ranks = np.full(1 << self.bits, NO_MERGE, np.int32)
        for (a, b), (rank, _) in self.merges.items():
            at = int(self._slot(np.array([a << 32 | b]))[0])
            while self.pair_keys[at] >= 0:
                at = (at + 1) % len(self.pair_keys)
            self.pair_keys[at], self.pair_ranks[at] = a << 32 | b, rank
        self.classes = _classes(Tokenizer.from_file(path))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or ``NO_MERGE``; an id below 0 merges with nothing."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(key)
        out = np.full(len(key), NO_MERGE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            found = self.pair_keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.pair_ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.pair_keys) - 1)
        return out


class Encoder:
    """Encodes texts with a bounded memory of splits met before, told apart by 64-bit hashes."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.hasher = vocab, textops.Hasher()
        self.added = re.compile("|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True)))) if vocab.added else None
        self.margin = max([3, *map(len, vocab.added)])  # characters beyond a border that can still move it
        self._forget()

    def _forget(self) -> None:
        self.seen, self.ids, self.counts = Seen(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours by rank, the leftmost first, as long as there is a merge."""
        merges, n = self.vocab.merges, len(ids)
        ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # one of the two is merged already
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            h = prv[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [t for t in ids if t >= 0]

    def _plain(self, raw: bytes) -> list[int]:
        return self.merge([self.vocab.byte_id[b] for b in raw])

    def merge_all(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged ids of many byte spans, one after the other, and their numbers.

        Spans of like size stand in the rows of a matrix; each round merges
        every row's lowest pair.
        """
        of_byte = np.array(self.vocab.byte_id, np.int32)
        counts = np.zeros(len(sizes), np.int64)
        by_size = np.argsort(sizes, kind="stable")
        at, found = int(np.searchsorted(sizes[by_size], 1)), []
        while at < len(by_size):
            width = int(sizes[by_size[at]]) * 5 // 4 + 1
            stop = min(int(np.searchsorted(sizes[by_size], width, "right")), at + max(1, MATRIX_CELLS // width))
            chosen = by_size[at:stop]
            at = stop
            n = sizes[chosen]
            width = int(n[-1])
            inside = np.arange(width) < n[:, None]
            ids = np.full((len(chosen), width + 1), -1, np.int32)
            ids[:, :width][inside] = of_byte[data[(starts[chosen][:, None] + np.arange(width))[inside]]]
            ranks = self.vocab.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(chosen), width)
            while len(chosen):
                rows, best = np.arange(len(chosen)), ranks.argmin(axis=1)
                rank = ranks[rows, best]
                done = rank == NO_MERGE
                if done.any():
                    counts[chosen[done]] = n[done]
                    found.append((chosen[done], n[done], ids[done][np.arange(width + 1) < n[done][:, None]]))
                    go = ~done
                    chosen, n, ids, ranks, best, rank = chosen[go], n[go], ids[go], ranks[go], best[go], rank[go]
                    rows = np.arange(len(chosen))
                    if not len(chosen):
                        break
                ids[rows, best] = self.vocab.merged[rank]
                later = np.arange(width) > best[:, None]
                ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
                ids[rows, n - 1] = -1
                ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NO_MERGE
                n = n - 1
                ranks[rows, best] = self.vocab.ranks(ids[rows, best], ids[rows, best + 1])
                inner = rows[best > 0]
                ranks[inner, best[inner] - 1] = self.vocab.ranks(ids[inner, best[inner] - 1], ids[inner, best[inner]])
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for chosen, n, ids in found:
            out[np.repeat(first[chosen] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes side by side, all one split."""
        if not left or not right:
            return left + right
        i, j = min(4, len(left)), min(4, len(right))
        while True:
            window = self._plain(self.raw(left[-i:]) + self.raw(right[:j]))
            left_agrees = i == len(left) or window[0] == left[-i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:-i] + window + right[j:]
            if not left_agrees:
                i = min(2 * i, len(left))
            if not right_agrees:
                j = min(2 * j, len(right))

    def split_ids(self, raw: bytes) -> list[int]:
        """The encoding of one split: leaves first, then a tree of joints."""
        if len(raw) <= LEAF:
            return self._plain(raw)
        starts = np.arange(0, len(raw), LEAF)
        ids, counts = self.merge_all(np.frombuffer(raw, np.uint8), starts, np.minimum(LEAF, len(raw) - starts))
        ends = np.cumsum(counts)
        parts = [ids[e - n:e].tolist() for e, n in zip(ends, counts)]
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def _sizes(self, text: str) -> list[int]:
        """Characters of every split of a text, added tokens among them."""
        classes = self.vocab.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes()
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += map(len, _SPLIT.findall(classes, at, m.start()))
            out.append(len(m.group()))
            at = m.end()
        out += map(len, _SPLIT.findall(classes, at))
        return out

    def splits(self, text: str) -> list[str]:
        ends = list(accumulate(self._sizes(text)))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def tokens(self, t: textops.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all splits, one after the other; their numbers per split; splits per row."""
        raw = t.data.tobytes()
        sizes, n_splits = [], np.zeros(t.n, np.int64)
        for row, (a, b) in enumerate(zip(t.offs[:-1], t.offs[1:])):
            own = self._sizes(raw[a:b].decode())
            n_splits[row] = len(own)
            sizes += own
        if not sizes:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), n_splits
        chars = np.append(np.flatnonzero((t.data & 0xC0) != 0x80), len(t.data))  # where each character begins
        ends = np.cumsum(np.array(sizes, np.int64))
        starts, ends = chars[ends - sizes], chars[ends]
        hashes = self.hasher(t.data, starts, ends)
        index, at = textops.distinct(hashes)
        if self.seen.full(len(at)) or len(self.ids) > CACHE_IDS:
            self._forget()
        place = self.seen.find(hashes[at])
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            ids, counts = self._fresh(t.data, raw, starts[at[fresh]], ends[at[fresh]])
            place[fresh] = self.seen.add(hashes[at[fresh]])
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
        first = np.cumsum(self.counts) - self.counts
        own = place[index]
        n = self.counts[own]
        return self.ids[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n, n_splits

    def _fresh(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of splits that were not met before: short ones together, long ones each by its tree."""
        sizes = ends - starts
        single = {}
        for k in np.flatnonzero(sizes > LEAF):
            single[k] = self.split_ids(raw[starts[k]:ends[k]])
        for token, i in self.vocab.added.items():
            for k in np.flatnonzero(sizes == len(token.encode())):
                if raw[starts[k]:ends[k]] == token.encode():
                    single[k] = [i]
        if not single:
            return self.merge_all(data, starts, sizes)
        usual = np.setdiff1d(np.arange(len(sizes)), list(single))
        ids, n = self.merge_all(data, starts[usual], sizes[usual])
        counts = np.zeros(len(sizes), np.int64)
        counts[usual] = n
        for k, own in single.items():
            counts[k] = len(own)
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        out[np.repeat(first[usual] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for k, own in single.items():
            out[first[k]:first[k] + len(own)] = own
        return out, counts

    def split_tokens(self, splits: list[str]) -> list[list[int]]:
        """The ids of each of a few splits."""
        return [[self.vocab.added[s]] if s in self.vocab.added else self.split_ids(s.encode()) for s in splits]

    def encode(self, t: textops.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and their numbers per row."""
        ids, sizes, n_splits = self.tokens(t)
        total = np.concatenate([[0], np.cumsum(sizes)])
        stops = np.cumsum(n_splits)
        return ids, total[stops] - total[stops - n_splits]

    def segment(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and how many of them each split has."""
        data = np.frombuffer(text.encode(), np.uint8)
        ids, sizes, _ = self.tokens(textops.Texts(data, np.array([0, len(data)]), 0, 1))
        return ids.tolist(), sizes.tolist()

    def join_segments(self, a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """``segment`` of two texts side by side, from those of each."""
        (a_ids, a_sizes), (b_ids, b_sizes) = a, b
        if not a_ids or not b_ids:
            return (b_ids, b_sizes) if not a_ids else a
        # the last splits of the left text, up to a border that what follows cannot move
        tail, tail_ids, text = 0, 0, ""
        while tail < len(a_sizes) and len(text) < self.margin:
            tail += 1
            tail_ids += a_sizes[-tail]
            text = self.raw(a_ids[-tail_ids:]).decode()
        cut, head = len(text), 4
        while True:
            head = min(head, len(b_sizes))
            sizes = b_sizes[:head]
            stops = list(accumulate(sizes))
            b_texts = [self.raw(b_ids[e - n:e]).decode() for e, n in zip(stops, sizes)]
            whole = text + "".join(b_texts)
            borders = list(accumulate(map(len, b_texts), initial=cut))  # of the right text
            splits = self.splits(whole)
            ends = list(accumulate(map(len, splits)))
            safe = len(whole) if head == len(b_sizes) else len(whole) - self.margin
            known = {e: k for k, e in enumerate(ends) if e <= safe}
            met = next((k for k, e in enumerate(borders) if e in known), None)
            if met is not None:
                break
            head *= 2
        between = splits[:known[borders[met]] + 1]
        used = stops[met - 1] if met else 0
        tokens = self._between(between, (a_ids[-tail_ids:], a_sizes[-tail:]), (b_ids[:used], b_sizes[:met]), cut)
        return ([*a_ids[:-tail_ids], *chain.from_iterable(tokens), *b_ids[used:]],
                [*a_sizes[:-tail], *map(len, tokens), *b_sizes[met:]])

    def _between(self, splits: list[str], left: tuple, right: tuple, cut: int) -> list:
        """Tokens of the splits around a joint; one long split across it is joined from its two halves' tokens."""
        ends = list(accumulate(map(len, splits)))
        k = bisect.bisect_right(ends, cut)
        if k == len(splits) or len(splits[k]) <= LEAF:
            return self.split_tokens(splits)
        a, b = (self.raw(ids[slice(*where)]).decode() for ids, where in
                ((left[0], (len(left[0]) - left[1][-1], None)), (right[0], (0, right[1][0] if right[1] else 0))))
        if a + b != splits[k]:
            return self.split_tokens(splits)
        return [*self.split_tokens(splits[:k]), self.join(list(left[0][-left[1][-1]:]), list(right[0][:right[1][0]])),
                *self.split_tokens(splits[k + 1:])]

    def join_all(self, parts: list[tuple[list[int], list[int]]]) -> list[int]:
        """The ids of consecutive segments, joined in a tree."""
        while len(parts) > 1:
            parts = [self.join_segments(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][0]


def _extended(df: DataFrame, name: str, kind) -> StructType:
    if name in df.columns:
        raise ValueError(f"{name} is a column of the table already")
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", out: str = "token_ids") -> DataFrame:
    """All rows and columns of ``docs`` and the ids of the whole ``text`` as array<int>.

    Ids are those of the tokenizers library without special tokens around the
    text; added tokens that stand in a text get their own id.  A null or empty
    text gives an empty array, an empty table no rows; ``out`` must not be a
    column of ``docs``.  Texts over ``SEGMENT_CHARS`` are encoded in segments by
    many tasks, equal ones once; only their ids meet in one task, as they must
    in one row.  Columns ``__text`` and ``__segment`` are reserved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    at = docs.columns.index(text)
    schema = _extended(docs, out, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for t in textops.chunks(batch.column(at), CHUNK_BYTES):
                lists = textops.list_array(*encoder.encode(t), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c[t.lo:t.hi] for c in batch.columns), lists], names=schema.names)

    is_long = F.coalesce(F.length(text) > SEGMENT_CHARS, F.lit(False))
    usual = docs.where(~is_long).mapInArrow(run, schema)
    long = docs.where(is_long).withColumn("__text", F.sha2(text, 256))
    ids = keep(_long_ids(long.select("__text", F.col(text).alias("text")), shared, out), "long_ids", lasting=True)
    return usual.unionByName(long.join(ids, "__text").drop("__text"))


def _long_ids(texts: DataFrame, shared, out: str) -> DataFrame:
    """One row for each distinct ``__text``: the ids of its segments, encoded apart and joined."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                for k, at in enumerate(range(0, len(text), SEGMENT_CHARS)):
                    yield pa.RecordBatch.from_pylist([{"__text": key, "__segment": k, "text": text[at:at + SEGMENT_CHARS]}], pieces)

    pieces = pa.schema([("__text", pa.string()), ("__segment", pa.int32()), ("text", pa.string())])
    segments = texts.mapInArrow(cut, "__text string, __segment int, text string").groupBy("__text", "__segment").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes = encoder.segment(batch.column(2)[row].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:row + 1], batch.column(1)[row:row + 1], pa.array([ids], pa.list_(pa.int32())),
                                                  pa.array([sizes], pa.list_(pa.int32()))], names=["__text", "__segment", "ids", "sizes"])

    encoded = segments.repartition("__text", "__segment").mapInArrow(run, "__text string, __segment int, ids array<int>, sizes array<int>")
    whole = encoded.groupBy("__text").agg(F.sort_array(F.collect_list(F.struct("__segment", "ids", "sizes"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                parts = [(p["ids"], p["sizes"]) for p in batch.column(1)[row].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:row + 1], pa.array([encoder.join_all(parts)], pa.list_(pa.int32()))],
                                                 names=["__text", out])

    return whole.mapInArrow(joined, StructType([StructField("__text", StringType()), StructField(out, ArrayType(IntegerType()))]))


def decode(df: DataFrame, model: str = DEFAULT_MODEL, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` and the text of the array ``ids``, added tokens included.

    Null gives null, an empty array an empty text; a null or unknown id is an
    error, and bytes that are no UTF-8 become U+FFFD.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model).bytes)
    at = df.columns.index(ids)
    schema = _extended(df, out, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                col = part.column(at)
                flat = col.flatten()
                if flat.null_count:
                    raise ValueError("an id is null")
                flat = flat.to_numpy()
                if len(flat) and (flat.min() < 0 or flat.max() >= len(token)):
                    raise ValueError("an id is not in the vocabulary")
                ends = np.cumsum(np.asarray(col.value_lengths().fill_null(0)))
                texts = [None if null else b"".join(map(token.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace")
                         for a, b, null in zip([0, *ends[:-1]], ends, np.asarray(col.is_null()))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
