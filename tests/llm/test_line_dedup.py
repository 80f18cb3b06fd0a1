"""Line dedup against brute force over all pairs of lines."""

import random

from gatecast.llm import line_dedup as ld


def every_window(s):
    return {s[i:i + 8] for i in range(max(len(s) - 7, 1))}


def brute(rows, min_chars):
    """Lines left per document, by exact similarity of all pairs."""
    lines = [(d, p, x.strip(" ")) for d, t in rows if t is not None for p, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= min_chars and x.strip()]
    sets, root = [every_window(x) for *_, x in lines], list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if lines[i][2] == lines[j][2] or 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    first = {}
    for i, (d, p, _) in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (d, p)), (d, p))
    gone = {(d, p) for i, (d, p, _) in enumerate(lines) if first[find(i)] != (d, p)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(60) for _ in range(5)]
    base = line(50).split()
    rows = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "short line"), (1004, "short line\nshort line")]
    for d in range(60):
        own = [line(rng.randint(4, 60)) for _ in range(rng.randint(1, 6))]
        if d % 3 == 0:
            own.insert(rng.randint(0, len(own)), "  " * (d % 2) + rng.choice(shared))
        if d % 4 == 0:
            near = list(base)
            near[rng.randrange(50)] = word()
            own.append(" ".join(near))
        rows.append((d, "\n".join(own)))
    rows.append((70, rows[20][1]))
    rows += [(80 + k, " ".join(["again"] * 40 + [word()])) for k in range(3)] + [(90, "unbroken" * 30), (91, "unbroken" * 31)]
    rows.append((71, "x" * 20000 + "\n" + "unbroken" * 30))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, node string, n_chars long")
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows, ld.MIN_CHARS)
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    emptied = {d for d, t in want.items() if t is not None and not t.strip(" ") and t != dict(rows)[d]}
    assert emptied == {70, 90, 91}
    assert {r.doc_id for r in ld.dedup_lines(docs, drop_emptied=True).collect()} == set(want) - emptied


def test_repeated_rows_nulls_and_empty_table(spark):
    long = "a line that is long enough to take part in the comparison"
    schema = "doc_id long, text string"
    rows = [(1, long), (1, long), (2, long), (None, "other " + "words of its own in a long line " * 2), (3, None)]
    got = sorted(ld.dedup_lines(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [r.text for r in got if r.doc_id == 1] == [long, long]
    assert [r.text for r in got if r.doc_id == 2] == [""]
    assert len(got) == 5
    assert ld.dedup_lines(spark.createDataFrame([], schema)).collect() == []


def test_every_position_counts(spark):
    """Brute force over the windows of all positions, with lines that differ only inside long words or have no blanks."""
    rng = random.Random(5)
    chinese = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(160))
    dates = [" ".join(f"2024-01-{rng.randint(1, 28):02d}" for _ in range(4)) for _ in range(30)]
    phones = [" ".join(f"+49-30-5550{rng.randint(1000, 9999)}" for _ in range(5)) for _ in range(30)]
    rows = [(k, x) for k, x in enumerate(dates + phones)]
    rows += [(100, chinese), (101, chinese[:30] + "x" + chinese[31:]), (102, "x" + chinese), (103, chinese[:80] * 2)]
    rows += [(104, "2024-01-05 2024-01-09 2024-01-13 2024-01-17"), (105, "2024-01-02 2024-01-21 2024-01-28 2024-01-30")]
    rows += [(200 + d, t) for d, t in corpus()]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, ld.MIN_CHARS)
    assert got[104] and got[105] and got[100] and not got[101] and not got[102]


def test_windows_of_short_and_long_lines(spark):
    lines = ["", "a", "1234567", "12345678", "123456789", "é" * 3 + "\U0001F600" * 6, "".join(chr(97 + i % 23) for i in range(100))]
    lines += ["".join(chr(0x4E00 + i) for i in range(n)) for n in range(20, 60)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", ld._windows("line").alias("w")).collect():
        assert set(r.w) == every_window(r.line) and len(r.w) == max(len(r.line) - 7, 1)


def test_sketches_keep_every_pair_at_the_linking_similarity(spark):
    """Of pairs from 0.8 upwards, whole sets or sketches, none goes; clearly unlike ones do."""
    rng, pairs = random.Random(5), []
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for k in range(400):
        line = word(rng.choice([20, 60, 71, 72, 90, 300, 900]))
        n = len(line)
        cut = rng.randrange(n // 2)
        other = rng.choice([line[:-(n // 6)], line[:cut] + "#" + line[cut + 1:], line + word(n // 6), line[:cut] + word(n // 12) + line[cut + n // 12:], word(n)])
        pairs.append((k, line, other))
    a, b = (spark.createDataFrame(pairs, "k long, a string, b string").select("k", ld._sketch(c).alias(c)) for c in "ab")
    near = {r.k: r.near for r in a.join(b, "k").select("k", ld._near("a", "b").alias("near")).collect()}
    linked = unlike = 0
    for k, x, y in pairs:
        s, t = every_window(x), every_window(y)
        if 100 * len(s & t) >= 80 * len(s | t):
            linked += 1
            assert near[k]
        elif 100 * len(s & t) < 30 * len(s | t):
            unlike += 1
            assert not near[k]
    assert linked > 100 and unlike > 50


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(100).cache()
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()} == brute(rows, ld.MIN_CHARS)


def test_short_lines_take_part(spark, tmp_path):
    """In op4 and the pipeline's stage: equal short lines go, copies leave no husk, blank lines stay."""
    import corpus_pipeline
    from gatecast.llm.queries import QUERIES
    copy = "Home\nSubscribe to our newsletter\n\n\u3053\u308c\u306f\u6587\u3067\u3059\u3002\nBy A. Writer"
    rows = [(1, copy), (2, copy), (3, "Home\n\t\nits own line"), (4, "Subscribe to our newsletters\n\t\nBy A. Writer\nx"), (5, "1234567\n12345678")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: copy, 2: "", 3: "\t\nits own line", 4: "\t\nx", 5: "1234567\n12345678"}
    got = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert {d: r.text for d, r in got.items()} == want
    stage = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert stage == {d: t for d, t in want.items() if d != 2}


def test_bands_of_similar_sets_meet_and_of_others_do_not(spark):
    """Small sets at the linking similarity always share a band; of random longer ones, with frequent windows, hardly any do."""
    rng, rows = random.Random(9), []
    for n in range(1, ld.SAMPLED - 1):
        for extra in range((n + 3) // 4 + 1):
            if 100 * n >= 80 * (n + extra):
                for _ in range(12):
                    big = sorted(rng.sample(range(10**9), n + extra))
                    rows.append((len(rows), sorted(rng.sample(big, n)), big, True))
    linked = len(rows)
    common = [rng.randrange(10**9) for _ in range(20)]
    for _ in range(2000):
        a, b = (sorted({*rng.sample(common, 6), *(rng.randrange(10**9) for _ in range(100))})[:ld.SIGNATURE] for _ in "ab")
        rows.append((len(rows), a, b, False))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>, same boolean")
    got = df.select("same", (ld.F.size(ld.F.array_intersect(ld._bands("a"), ld._bands("b"))) > 0).alias("met")).collect()
    assert all(r.met for r in got if r.same) and linked > 500
    assert sum(r.met for r in got if not r.same) < 20


def test_parities_lose_no_link_and_rule_out_what_just_fails(spark):
    """Lines at 0.8 or more stay; of those under 0.7, sketches alone would keep many."""
    rng, pairs = random.Random(11), []
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for k in range(300):
        line, cut = word(rng.choice([60, 250, 400])), rng.randint(1, 4)
        other = list(line)
        for _ in range(cut * len(line) // 100):
            other[rng.randrange(len(line))] = "#"
        pairs.append((k, line, "".join(other)))
    df = spark.createDataFrame(pairs, "row long, a string, b string")
    sides = [df.select("row", ld.F.col(c).alias("line")).join(ld._odd(df.select("row", ld.F.col(c).alias("line"))), "row")
             .select("row", ld.F.struct(ld._sketch("line")["n"].alias("n"), "odd").alias(c)) for c in "ab"]
    near = {r.row: r.near for r in sides[0].join(sides[1], "row").select("row", ld._differ_little("a", "b").alias("near")).collect()}
    linked = unlike = kept = 0
    for k, x, y in pairs:
        s, t = every_window(x), every_window(y)
        if 100 * len(s & t) >= 80 * len(s | t):
            linked += 1
            assert near[k]
        elif 100 * len(s & t) < 70 * len(s | t):
            unlike, kept = unlike + 1, kept + near[k]
    assert linked > 50 and unlike > 50 and kept < unlike / 10
