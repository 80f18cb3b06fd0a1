"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes.  It is cut into
fragments, and each document's set into one segment per fragment.

Candidates.  Two sets of Jaccard similarity t or more differ in at most
D = (|a| + |b|)(1 - t)/(1 + t) n-grams.  Cut into F > D fragments, at least
F - D of their segments agree, so an equal segment (its hash, fragment and
size class) brings the pair together.  F follows the size class; a set near
the next class is also cut as that class.  A set with so many empty segments
that the equal ones could all be empty also gives its t-prefix in the global
order, under which two such sets must meet.  No candidate can be missed, and
no frequent n-gram makes a bucket of its own.

Ruling out.  A set's sketch is one bit per hash value modulo 1024, the parity
of the n-grams that fall there.  Each n-gram in which two sets differ flips one
bit, so sketches that differ in more than D bits belong to sets that differ in
more than D n-grams: such pairs are never counted, and no other is lost.

Counting.  For candidate pairs the partial overlaps are counted fragment by
fragment and summed per pair; the sum decides.

Equal sets form one node beforehand.  Pairs inside a group that is already
connected are not listed (see ``graph.link_buckets``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm import graph, textops
from gatecast.llm.store import broadcast_ids, keep, scratch

GROWTH = 1.5          # ratio of neighbouring size classes
LARGEST = 1 << 40
COUNT_FRAGMENTS = 8   # fragments in which overlaps are counted
SKETCH_WORDS = 16     # of 64 bits
PASSES = 16           # over the keys of all sets, each with a part of the shared ones


def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes and the largest difference D within each."""
    lo = -(-(100 + percent) // (2 * (100 - percent)))
    low = []
    while lo < LARGEST:
        low.append(lo)
        lo = int(lo * max(GROWTH, 100 / percent + 0.01)) + 1
    high = np.array([*low[1:], LARGEST], np.int64) - 1
    return np.array(low, np.int64), 2 * high * (100 - percent) // (100 + percent)


def document_sets(t: textops.Texts, hasher: textops.Hasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, one after the other, and their numbers."""
    t = textops.lower_ascii(t)
    starts, ends, rows = textops.words(t)
    h, r, _ = textops.windows(hasher(t.data, starts, ends), rows, t.n, n, short=True)
    order = np.argsort(r, kind="stable")
    h, count = h[order], np.bincount(r, minlength=t.n)
    at, parts, sizes = 0, [], np.zeros(t.n, np.int64)
    for i, c in enumerate(count):
        if c:
            parts.append(np.unique(h[at:at + c]))
            sizes[i] = len(parts[-1])
            at += c
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def set_marks(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two columns; empty sets get zeros."""
    full = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            out[k, full] = np.add.reduceat(textops.mix(h ^ np.uint64(salt)), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def odd_sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity of the n-grams per value modulo the sketch's bits, SKETCH_WORDS longs a row."""
    bits = SKETCH_WORDS * 64
    bit = (textops.mix(h ^ np.uint64(0x1D8E4E27C47D124F)) % np.uint64(bits)).astype(np.int64)
    ends, out = np.cumsum(sizes), []
    for lo in range(0, len(sizes), 2048):
        hi = min(lo + 2048, len(sizes))
        a, b = (ends[lo] - sizes[lo], ends[hi - 1])
        row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        odd = np.bincount(row * bits + bit[a:b], minlength=(hi - lo) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segment_keys(h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which similar sets meet, row by row, and their numbers."""
    low, diff = size_classes(percent)
    parts = diff + 1 + diff // 8 + 1
    own = np.searchsorted(low, sizes, "right") - 1
    nxt = own + 1
    near = (sizes > 0) & (nxt < len(low)) & (100 * sizes >= percent * low[np.minimum(nxt, len(low) - 1)])
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes + (-percent * sizes) // 100 + 1
    keys, rows = [], []
    for cls, use in ((own, (own >= 0) & (sizes > 0)), (nxt, near)):
        sel = use[row_of]
        r, x, k = row_of[sel], h[sel], rank[sel]
        if not len(r):
            continue
        c = cls[r]
        seg = ((x >> np.uint64(32)) * parts[c].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(textops.mix(x ^ np.uint64(0x8EBC6AF09C88C6E3)), at)
        place = textops.mix((c[at].astype(np.uint64) << np.uint64(48)) ^ seg[at])
        keys.append(textops.mix(total + place))
        rows.append(r[at])
        filled = np.bincount(r[at], minlength=len(sizes))
        loose = use & (filled <= diff[np.maximum(cls, 0)])
        extra = loose[r] & (k < prefix[r])
        keys.append(textops.mix(x[extra] ^ textops.mix(c[extra].astype(np.uint64) + np.uint64(0x589965CC75374CC3))))
        rows.append(r[extra])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return key[order].view(np.int64), np.bincount(row, minlength=len(sizes))


def _marked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: id, set size, set mark, sketch and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = textops.Hasher()
        for batch in batches:
            for t in textops.chunks(batch.column("text")):
                h, sizes = document_sets(t, hasher, n)
                s1, s2 = set_marks(h, sizes)
                keys, count = segment_keys(h, sizes, percent)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[t.lo:t.hi], pa.array(sizes), pa.array(s1), pa.array(s2),
                     textops.list_array(odd_sketches(h, sizes), np.full(t.n, SKETCH_WORDS), pa.int64()),
                     textops.list_array(keys, count, pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch", "keys"])

    schema = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch array<bigint>, keys array<bigint>"
    return docs.mapInArrow(run, schema)


def _segments(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Rows ``(node, fragment, grams)`` of the given nodes' sets, read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = textops.Hasher()
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            m1 = batch.column("s1").to_numpy(zero_copy_only=False)
            m2 = batch.column("s2").to_numpy(zero_copy_only=False)
            for t in textops.chunks(batch.column("text")):
                h, sizes = document_sets(t, hasher, n)
                s1, s2 = set_marks(h, sizes)
                same = (s1 == m1[t.lo:t.hi]) & (s2 == m2[t.lo:t.hi])
                row = np.repeat(np.arange(t.n), sizes)
                x, row = h[same[row]], row[same[row]]
                frag = (((x >> np.uint64(32)) * np.uint64(COUNT_FRAGMENTS)) >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (frag[1:] != frag[:-1])])) if len(row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[t.lo:t.hi][row[at]], pa.int64()), pa.array(frag[at], pa.int64()),
                     textops.list_array(x.view(np.int64), np.diff(np.append(at, len(x))), pa.int64())],
                    names=["node", "fragment", "grams"])

    # a few longs a node, so the texts stay where they are unless the nodes are very many
    chosen = broadcast_ids(nodes.select(F.col("doc").alias("doc_id"), "node", "s1", "s2"))
    return docs.join(chosen, "doc_id").select("node", "s1", "s2", "text").mapInArrow(
        run, "node bigint, fragment bigint, grams array<bigint>")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Join documents whose n-gram sets have a Jaccard similarity of ``percent``/100 or more.

    ``docs`` needs doc_id (long) and text; other columns are left aside.
    Returns a row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links).  Words are lower-cased in A-Z; a text
    of fewer than ``n`` words is one n-gram.  A null or wordless text has an
    empty set, links with nothing and is its own component.  Rows with equal
    sets are linked, repeated rows included.  A set that only rows of null
    doc_id have links to nothing else, and its component_id is null.  An empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        marked = keep(_marked(texts, n, percent).withColumn("row", F.monotonically_increasing_id()), "marks")
        # Texts are found again by doc_id, so a node prefers a row that has one.
        nodes = keep(marked.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles")
                     .agg(F.min("row").alias("node"), F.min("doc_id").alias("doc")), "nodes")
        # rows that repeat a node's set, or whose set has no id, bring no keys
        same = ["s1", "s2", "n_shingles"]
        again = keep(marked.select("row", *same).join(nodes, same).where("row <> node or doc is null").select("row"), "again")
        buckets = (marked.join(broadcast_ids(again), "row", "left_anti")
                   .select(F.col("row").alias("node"), F.explode(F.array_distinct("keys")).alias("key")))

        def verify(pairs: DataFrame) -> DataFrame:
            used = keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "used")
            chosen = keep(nodes.join(broadcast_ids(used), "node"), "chosen")
            size = chosen.select("node", "n_shingles")
            segments = keep(_segments(texts, chosen, n), "segments")
            left = pairs.join(segments.withColumnRenamed("node", "a"), "a")
            right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("others"))
            partial = (left.join(right, ["b", "fragment"])
                       .select("a", "b", F.struct("fragment", F.size(F.array_intersect("grams", "others")).alias("common")).alias("part")))
            # a set: a repeated row of a document gives its segments again
            parts = partial.groupBy("a", "b").agg(F.collect_set("part").alias("parts"))
            total = parts.select("a", "b", F.aggregate("parts", F.lit(0).cast("long"), lambda x, p: x + p["common"]).alias("common"))
            sized = (total.join(broadcast_ids(size.toDF("a", "na")), "a").join(broadcast_ids(size.toDF("b", "nb")), "b"))
            return (sized.where(F.col("common") * 100 >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common")))
                    .select("a", "b"))

        def may_link(a: str, b: str) -> Column:
            differ = sum((F.bit_count(F.get(F.col(a)["sketch"], F.lit(i)).bitwiseXOR(F.get(F.col(b)["sketch"], F.lit(i))))
                          for i in range(SKETCH_WORDS)), F.lit(0))
            na, nb = F.col(a)["n_shingles"], F.col(b)["n_shingles"]
            return ((F.greatest(na, nb) * percent <= F.least(na, nb) * 100)
                    & (differ * (100 + percent) <= (na + nb) * (100 - percent)))

        def marks(of: DataFrame) -> DataFrame:
            wanted = broadcast_ids(of.select(F.col("node").alias("row")))
            return marked.join(wanted, "row").select(F.col("row").alias("node"), F.struct("n_shingles", "sketch").alias("mark"))

        comp = graph.link_buckets(graph.shared_buckets(buckets, PASSES), verify, marks, may_link, exact=True)
        rooted = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
        named = rooted.join(best, "root").select("s1", "s2", "n_shingles", "component_id")
        found = (marked.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
                .select("doc_id", "n_shingles",
                        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
        return keep(found, "components", lasting=True)


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked to one of a smaller doc_id.

    Columns and all other rows stay as they are.  Of repeated rows of a kept
    document that has words, one stays.  Rows with a null doc_id stay.
    """
    found = ngram_components(docs, n, percent).where("doc_id is not null")
    verdict = found.groupBy("doc_id").agg(
        F.max(F.col("component_id") < F.col("doc_id")).alias("__goes"), F.count("*").alias("__rows"),
        F.max("n_shingles").alias("__size"))
    # a few longs a document that goes or is repeated, so the texts stay where they are
    marks = keep(verdict.where("__goes or __rows > 1"), "verdict", lasting=True)
    joined = docs.join(broadcast_ids(marks.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"), "left")
    once = joined.where("__id is null or (not __goes and __size = 0)").select(*docs.columns)
    repeated = joined.where("not __goes and __rows > 1 and __size > 0").select(*docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(repeated)
