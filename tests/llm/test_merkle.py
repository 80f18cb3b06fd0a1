import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gatecast.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root and, for every leaf, its (left, right) siblings, by plain levels."""
    proofs = [[] for _ in leaves]
    at = list(range(len(leaves)))
    level = leaves
    while len(level) > 1:
        runs = [level[k:k + 3] for k in range(0, len(level), 3)]
        for i, p in enumerate(at):
            run, k = runs[p // 3], p % 3
            proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            at[i] = p // 3
        level = [sha("".join(r)) for r in runs]
    return level[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((-1 if r[0] is None else r[0], sha("".join(map(cell, r))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([h for _, h, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    root, upper = tree([built[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, upper):
        for (_, leaf, r), proof in zip(sorted(groups[g], key=lambda x: x[:2]), built[g][1]):
            proof = proof + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[4].replace("\n", "") if hit and r[4] is not None else r[4]
            folded = sha("".join(map(cell, (*r[:4], text))))
            for left, right in proof:
                folded = sha(left + folded + right)
            out.append((r[0], leaf, built[g][0], root, sha("".join(a + b for a, b in proof)), folded, folded == root))
    return out


CASES = {
    "one row": [(5, "a", "en", 1, "x")],
    "nulls": [(None, None, None, None, None), (2, None, "en", 3, "a\nb"), (None, "s", "en", 3, ""), (3, "s", None, None, "é\n\n")],
    "repeated rows and ids": [(1, "a", "en", 1, "x\ny")] * 30 + [(1, "a", "en", 1, "z")] * 4 + [(2, "b", "en", 1, "z")],
    "sources of many sizes": [(i, f"s{i % 40 if i % 3 else 0}", "en", i, f"t{i}\n" * (i % 4)) for i in range(2500)],
    "long text": [(1, "a", "en", 1, "ab\n" * 500_000), (2, "a", "en", 1, None)],
    "a source each": [(i, f"s{i}", "en", i, "x\n") for i in range(900)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case):
    docs = spark.createDataFrame(CASES[case], SCHEMA).repartition(5)
    got = merkle.verified_manifest(docs.withColumn("root", F.lit(1)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(CASES[case])))


def test_empty_table_and_clashes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_manifest(none).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(none.withColumn("proof", F.lit(1)).withColumn("leaf", F.lit("")), "source", [F.col("doc_id")], "leaf")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 728, 729])
def test_sweeps_of_one_block(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, proofs = tree(leaves)
    nodes = merkle.forward(leaves, top=True)
    assert merkle.root_of(leaves, nodes) == root
    assert merkle.backward(n, nodes, []) == proofs


def test_block_below_others_keeps_its_height():
    nodes = merkle.forward(["a"], top=False)
    assert sorted(level for level, _ in nodes) == list(range(1, merkle.LEVELS + 1))
    assert merkle.backward(1, nodes, [("u", "v")]) == [[("", "")] * merkle.LEVELS + [("u", "v")]]


def test_a_changed_text_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "a\nb") for i in range(40)], SCHEMA)
    rows = merkle.verified_manifest(docs).collect()
    assert {r.doc_id for r in rows if not r.verified} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 2 == 0}
