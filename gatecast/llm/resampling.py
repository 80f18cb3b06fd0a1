"""Importance resampling towards a target distribution over hashed n-grams.

Words are found by an Aho-Corasick dictionary.  Each distinct word stands in
it with its delimiters, and carries as payload its CRC-32 and its lengths.  Texts are
scanned with every delimiter turned into a space; each match emits a word's
payload.  What lies between two matches are words that the dictionary does not
know yet: their payloads are made on the spot, and they join it at the next
rebuilding, while it has room.  So the dictionary grows with what a task meets,
is bounded, and never decides which words count.

The CRC of a run of words comes from the payloads alone: the CRC of a
concatenation is the first one's CRC, carried on by as many zero bytes as
the second is long, xor the second's.

A feature's bucket is its CRC modulo the number of buckets.  Counts of buckets
over the corpus and over the target give each bucket's gain, a document's weight
is the sum of its features' gains, and a seeded Gumbel noise makes drawing the
highest scores a draw without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gatecast.llm import textops
from gatecast.llm.positions import with_positions
from gatecast.llm.store import keep, scratch

BUCKETS = 10_000
CHUNK_BYTES = 2 << 20
DICTIONARY_CHARS = 1_000_000  # of all words in a task's dictionary, some 40 bytes of memory each
LONGEST = 64                  # characters of a word in the dictionary; longer ones are always worked on as found
REBUILD_CHARS = 20_000

# bytes of words stay, A-Z in lower case; every other byte below 0x80 is a delimiter
_NORMAL = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Dictionary:
    """Aho-Corasick automaton over delimiter-bounded words; ``scan`` emits the payloads of all words in order."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: dict[str, int] = {}
        self.crcs, self.sizes, self.chars = array("L"), array("q"), array("q")
        self.automaton = None
        self.n_chars = self.built_chars = 0

    def _payload(self, word: str) -> int:
        raw = word.encode()
        self.crcs.append(zlib.crc32(raw))
        self.sizes.append(len(raw))
        self.chars.append(len(word))
        return len(self.crcs) - 1

    def _build(self) -> None:
        import ahocorasick

        self.known.update(self.fresh)
        self.fresh.clear()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, payload in self.known.items():
            self.automaton.add_word(f" {word} ", payload)
        self.automaton.make_automaton()
        self.built_chars = self.n_chars

    def scan(self, text: str, crcs: array, sizes: array) -> int:
        """Append the CRC and the byte length of every word of a normalised text; their number."""
        if self.n_chars - self.built_chars > max(REBUILD_CHARS, self.built_chars // 2):
            self._build()
        text = f" {text} "
        before = len(crcs)
        crc_of, size_of, chars_of = self.crcs, self.sizes, self.chars
        last = 0  # the delimiter after the last word that is done
        if self.automaton is not None:
            for end, payload in self.automaton.iter(text):
                start = end - chars_of[payload] - 1
                if start != last:
                    self._unknown(text[last + 1:start], crcs, sizes)
                crcs.append(crc_of[payload])
                sizes.append(size_of[payload])
                last = end
        self._unknown(text[last + 1:], crcs, sizes)
        return len(crcs) - before

    def _unknown(self, gap: str, crcs: array, sizes: array) -> None:
        for word in gap.split(" "):
            if not word:
                continue
            payload = self.fresh.get(word)
            if payload is None:
                if len(word) > LONGEST or self.n_chars + len(word) > DICTIONARY_CHARS:
                    raw = word.encode()
                    crcs.append(zlib.crc32(raw))
                    sizes.append(len(raw))
                    continue
                payload = self.fresh[word] = self._payload(word)
                self.n_chars += len(word)
            crcs.append(self.crcs[payload])
            sizes.append(self.sizes[payload])


def _zeros_operator(n_bytes: int) -> np.ndarray:
    """Four tables of 256 that carry a CRC on by ``n_bytes`` (a power of two) zero bytes."""
    base = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            c = b << (8 * k)
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            base[k, b] = c
    while n_bytes > 1:
        base = np.stack([_carry(base, base[k]) for k in range(4)])
        n_bytes //= 2
    return base


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255] ^ tables[2][(crc >> np.uint32(16)) & 255]
            ^ tables[3][crc >> np.uint32(24)])


class Composer:
    """CRC-32 of concatenations, from the parts' CRCs and lengths."""

    def __init__(self) -> None:
        self.tables: list[np.ndarray] = []

    def __call__(self, crc: np.ndarray, more: np.ndarray, more_bytes: np.ndarray) -> np.ndarray:
        left, k = crc.astype(np.uint32), 0
        rest = more_bytes.astype(np.int64)
        while rest.any():
            if k == len(self.tables):
                self.tables.append(_zeros_operator(1 << k))
            odd = (rest & 1).astype(bool)
            left[odd] = _carry(self.tables[k], left[odd])
            rest, k = rest >> 1, k + 1
        return left ^ more.astype(np.uint32)


_SPACE_CRC = np.uint32(zlib.crc32(b" "))


def runs(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray, most: int, compose: Composer) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``most`` words of every row, and each one's row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    out, owner = [crcs], [rows]
    crc, size = crcs, sizes
    for n in range(2, most + 1):
        if len(rows) < n:
            break
        one = np.ones(len(rows) - n + 1, np.int64)
        spaced = compose(crc[:len(one)], np.full(len(one), _SPACE_CRC), one)
        crc = compose(spaced, crcs[n - 1:], sizes[n - 1:])
        size = size[:len(one)] + 1 + sizes[n - 1:]
        whole = rows[:len(one)] == rows[n - 1:]
        out.append(crc[whole])
        owner.append(rows[:len(one)][whole])
    return np.concatenate(out), np.concatenate(owner)


def with_buckets(docs: DataFrame, text: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """All rows and other columns of ``docs``, with ``n_words`` and ``buckets``: one bucket for every feature, repeats kept.

    Features are the runs of 1 to ``max_words`` consecutive words, joined by
    one space; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text
    with A-Z in lower case.  A null or empty text has none.
    """
    at = docs.columns.index(text)
    others = [c for c in docs.columns if c != text]
    schema = StructType([*(docs.schema[c] for c in others), StructField("n_words", LongType()), StructField("buckets", ArrayType(IntegerType()))])
    if len(set(schema.names)) != len(schema.names):
        raise ValueError("columns n_words and buckets clash with those of the table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, compose = Dictionary(), Composer()
        for batch in batches:
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            for t in textops.chunks(batch.column(at), CHUNK_BYTES):
                crcs, sizes = array("L"), array("q")
                raw = t.data.tobytes().translate(_NORMAL)
                counts = np.array([words.scan(raw[a:b].decode(), crcs, sizes) for a, b in zip(t.offs[:-1], t.offs[1:])], np.int64)
                found, owner = runs(np.array(crcs, np.uint32), np.array(sizes, np.int64), counts, max_words, compose)
                if max_words > 1:
                    found = found[np.argsort(owner, kind="stable")]
                lists = textops.list_array((found % np.uint32(buckets)).astype(np.int32), np.bincount(owner, minlength=t.n), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c[t.lo:t.hi] for c in rest), pa.array(counts), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all)))
                     for b in range(buckets)], np.int64)


def with_weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``buckets`` replaced by ``n_features`` and ``weight``, the sum of the gains (0 of none)."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    at = rows.columns.index("buckets")
    others = [c for c in rows.columns if c != "buckets"]
    schema = StructType([*(rows.schema[c] for c in others), StructField("n_features", LongType()), StructField("weight", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            counts = np.asarray(col.value_lengths()).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared.value[col.flatten().to_numpy()])])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pa.array(counts),
                                              pa.array(total[ends] - total[ends - counts])], names=schema.names)

    return rows.mapInArrow(run, schema)


def noise(doc_id: str, seed: int) -> Column:
    """Seeded Gumbel noise of an id, in thousandths; a null id counts as the text ``null``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             max_words: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Of the N rows with at least ``least_words`` words, the ``N * percent div 100``
    highest scores are drawn and ranked from 1; ties go to the smaller id (a
    null id first), and rows that tie in both take their ranks in any order.
    ``rank`` is null for the others.  Rows of equal id share their noise.
    Other columns are not read.  Empty ``docs`` give no rows; an empty
    ``target`` gives gains from the corpus alone.
    """
    with scratch(docs.sparkSession):
        found = keep(with_buckets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", max_words, buckets), "buckets")
        wanted = with_buckets(target.select(F.col(target_text).alias("text")), "text", max_words, buckets)
        # at most one row a bucket
        gain = gains(*(dict(bucket_counts(x).collect()) for x in (found, wanted)), buckets)
        scored = with_weights(found, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
        scored = keep(scored, "scored", lasting=True)
        able = F.col("n_words") >= least_words
        drawn = F.floor(F.lit(percent) * F.col("__all") / 100)
        ranked = with_positions(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], None, "__place", "__all")
        ranked = keep(ranked.withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1)), "ranked", lasting=True)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*names))
