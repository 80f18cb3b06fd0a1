"""Merkle manifests of large tables by time-forward processing.

Every group's leaves form a tree of runs of three; the groups' roots form one
more such tree.  A tree is worked on in blocks of ``3**LEVELS`` consecutive
nodes, and the blocks' roots are the next round's nodes, so a task never holds
more than one block, however large a group is.

Within a block nodes are visited in the order of their labels: the last leaf
below a node, then its level.  A node's digest travels forward in time through
a priority queue that is ordered by label, to be met when the sweep reaches its
parent.  The second sweep goes back: from the highest label down, every node takes
the proof of its parent out of the queue and sends each child that proof with
the child's siblings in front, until the leaves hold their whole proofs.
Spark's sort is the queue's outer part: it brings nodes to the sweep in label
order and spills.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gatecast.llm.positions import with_positions
from gatecast.llm.store import keep, scratch

ARITY = 3
LEVELS = 6
BLOCK = ARITY ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def leaf_digest(values: list[Column]) -> Column:
    """Hex sha256 of the values, each ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: str) -> Column:
    """Hex sha256 of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: str, proof: str) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, F.col(leaf), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def forward(leaves: list[str], top: bool) -> dict[tuple[int, int], list[str]]:
    """Sweep over the labels of one block: the children's digests of every inner node, by (level, place).

    A block that is a whole tree (``top``) ends in the level that has one
    node; any other block is ``LEVELS`` high.
    """
    height = LEVELS
    if top:
        height, n = 0, len(leaves)
        while n > 1:
            height, n = height + 1, -(-n // ARITY)
    queue: list[tuple[int, int, str]] = []  # (label of the parent: last leaf, level; digest)
    nodes = {}

    def send(level: int, place: int, digest: str) -> None:
        if level < height:
            last = min((place // ARITY + 1) * ARITY ** (level + 1), len(leaves)) - 1
            heapq.heappush(queue, (last, level + 1, place, digest))

    for at, leaf in enumerate(leaves):
        send(0, at, leaf)
        while queue and queue[0][0] == at:  # inner nodes whose time has come
            _, level, place, digest = heapq.heappop(queue)
            children = [digest]
            while queue and queue[0][:2] == (at, level):
                children.append(heapq.heappop(queue)[3])
            nodes[level, place // ARITY] = children
            send(level, place // ARITY, _hash(children))
    return nodes


def root_of(leaves: list[str], nodes: dict[tuple[int, int], list[str]]) -> str:
    return _hash(nodes[max(nodes)]) if nodes else leaves[0]


def backward(n: int, nodes: dict[tuple[int, int], list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Reversed sweep: every leaf's siblings from its own level to the block's root, then ``above``."""
    top = max(nodes) if nodes else (0, 0)
    queue = [(-(n - 1), -top[0], -top[1], above)]
    proofs: list = [None] * n
    while queue:
        _, level, place, suffix = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            proofs[place] = suffix
            continue
        children = nodes[level, place]
        for k in range(len(children)):
            child = place * ARITY + k
            last = min((child + 1) * ARITY ** (level - 1), n) - 1
            siblings = ("".join(children[:k]), "".join(children[k + 1:]))
            heapq.heappush(queue, (-last, 1 - level, -child, [siblings, *suffix]))
    return proofs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one (group, block); rows come sorted."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["__tree"], row["__block"])
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("__tree", "__block").sortWithinPartitions("__tree", "__block", "__at")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("__block", F.floor(F.col("__at") / F.lit(BLOCK)))


_ROOTS = StructType([StructField("__tree", StringType()), StructField("__at", LongType()), StructField("__size", LongType()),
                     StructField("digest", StringType())])


def _block_roots(nodes: DataFrame) -> DataFrame:
    """One row a block: its root, at the block's number, in a tree of as many nodes as there are blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("__tree", pa.string()), ("__at", pa.int64()), ("__size", pa.int64()), ("digest", pa.string())])
        for rows in _blocks(batches):
            size = rows[0]["__size"]
            leaves = [r["digest"] for r in rows]
            root = root_of(leaves, forward(leaves, size <= BLOCK))
            yield pa.RecordBatch.from_pylist([{"__tree": rows[0]["__tree"], "__at": rows[0]["__block"],
                                               "__size": -(-size // BLOCK), "digest": root}], schema)

    return _by_block(nodes.select("__tree", "__block", "__at", "__size", "digest")).mapInArrow(run, _ROOTS)


def _proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The proof of every node, given that of every block's root (``above``: tree, place, proof, root)."""
    carried = [c for c in nodes.columns if c not in ("__tree", "__block", "__at", "__size", "digest")]
    heads = above.select("__tree", F.col("__at").alias("__block"), F.lit(-1).cast("long").alias("__at"), "proof", "root", "top")
    both = nodes.unionByName(heads, allowMissingColumns=True)
    out = StructType([*(nodes.schema[c] for c in ("__tree", "__at", "digest", *carried)), StructField("proof", PROOF),
                      StructField("root", StringType()), StructField("top", StringType())])
    pair = pa.struct([("left", pa.string()), ("right", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema
                yield batch

        for head, *rows in _blocks(typed(batches)):
            if head["__at"] >= 0:
                raise ValueError("a block without the proof of its root")
            leaves = [r["digest"] for r in rows]
            inner = forward(leaves, rows[0]["__size"] <= BLOCK)
            proofs = backward(len(rows), inner, [(p["left"], p["right"]) for p in head["proof"]])
            sizes, flat = [0], []
            for p in proofs:
                flat += p
                sizes.append(len(flat))
            pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())],
                                               fields=list(pair))
            n = len(rows)
            columns = [pa.array([r[c] for r in rows], kinds.field(c).type) for c in ("__tree", "__at", "digest", *carried)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs),
                                              pa.array([head["root"]] * n, pa.string()), pa.array([head["top"]] * n, pa.string())],
                                             names=["__tree", "__at", "digest", *carried, "proof", "root", "top"])

    return _by_block(both).mapInArrow(run, out)


def _forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' nodes, lowest first, and one row a tree with its root."""
    rounds = [_with_block(nodes)]
    while True:
        roots = keep(_block_roots(rounds[-1]), "block_roots")
        if not roots.where("__size > 1").limit(1).count():
            return rounds, roots
        rounds.append(_with_block(roots))


def _descend(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Proofs of the lowest nodes, from ``heads``: tree, place, proof above the root, root and top."""
    for nodes in reversed(rounds):
        heads = keep(_proofs(nodes, heads), "proofs")
    return heads


def manifest(rows: DataFrame, group: str, order: list[Column], digest: str) -> DataFrame:
    """All rows and columns of ``rows`` with ``subroot``, ``root`` and ``proof``.

    ``digest`` is a string column with a row's leaf.  Leaves of equal ``group``
    ascend by ``order``, then by leaf; while there are several nodes, every three
    consecutive ones (in the last run fewer, even one) become the hash of
    their digests.  What remains is the group's ``subroot``; subroots, null
    first and else by the group's UTF-8 bytes, give ``root`` likewise.  ``proof``
    is an array of (left, right): the digests of a run's other nodes, from the
    leaf up to ``root``, both levels of trees together.

    Repeated rows are leaves of their own; an empty table gives no rows.  Nulls
    may stand in any column but ``digest``.  Columns named ``subroot``,
    ``root``, ``proof`` or beginning with ``__`` are an error.
    """
    clash = [c for c in rows.columns if c in ("subroot", "root", "proof", "top", "position") or c.startswith("__")]
    if clash:
        raise ValueError(f"columns {clash} clash with the manifest's own")
    # "-" sorts before "=": null first, then bytewise
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    named = rows.withColumn("__tree", tree)
    if digest != "digest":
        if "digest" in rows.columns:
            raise ValueError("a column digest clashes with the manifest's own")
        named = named.withColumnRenamed(digest, "digest")
    with scratch(rows.sparkSession):
        placed = with_positions(named, [*order, F.col("digest")], "__tree", "__at", "__size")
        leaves = keep(placed, "leaves", lasting=True)
        rounds, roots = _forest(leaves)
        names = roots.select(F.col("__tree").alias("name"), "digest").withColumn("__tree", F.lit(""))
        upper = keep(with_positions(names, [F.col("name")], "__tree", "__at", "__size"), "subroots")
        upper_rounds, top = _forest(upper)
        whole = top.select("__tree", F.lit(0).cast("long").alias("__at"), F.array().cast(PROOF).alias("proof"),
                           F.col("digest").alias("root"), F.col("digest").alias("top"))
        above = _descend(upper_rounds, whole).select(
            F.col("name").alias("__tree"), F.lit(0).cast("long").alias("__at"), "proof", F.col("digest").alias("root"), "top")
        heads = keep(_descend(rounds[1:], above), "block_proofs", lasting=True)
    done = _proofs(rounds[0], heads)
    return done.select(*[F.col("digest").alias(digest) if c == digest else F.col(c) for c in rows.columns],
                       F.col("root").alias("subroot"), F.col("top").alias("root"), "proof")


def tampered(doc_id: Column) -> Column:
    """Whether 2 divides the unsigned crc32 of the id as text; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents``, and whether each row's leaf leads to the root after tampering.

    Rows chosen by ``tampered`` lose the ``\\n`` characters of their text before
    their leaf is made again; a null text stays null.  A row whose text has
    none is thereby unchanged and verifies.
    """
    cells = [F.col(c) for c in FIELDS]
    altered = F.when(tampered(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_digest(cells).alias("leaf"), leaf_digest([*cells[:-1], altered]).alias("shown"))
    done = manifest(leaves, "source", [F.col("doc_id").asc_nulls_first()], "leaf")
    return (done.withColumn("proof_sha256", proof_digest("proof")).withColumn("folded_root", folded("shown", "proof"))
            .withColumn("verified", F.col("folded_root") == F.col("root"))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
