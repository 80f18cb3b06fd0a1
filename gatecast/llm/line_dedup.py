r"""Line dedup by MinHash, with DataFrame functions only.

Lines are the ``\n``-split parts of a text, compared after trimming blanks.
Lines of at least ``min_chars`` characters that are not all white space take
part; the others always stay.  With a ``min_chars`` of 1 there is no floor.

1. Equal lines form one node (a 96-bit hash).
2. A line's shingles are all its 8-character windows, or the whole line if it
   is shorter.  Its signature is a bottom-k MinHash: the 40 smallest distinct
   hashes.
3. Each run of four neighbours in the signature makes a band; of 32 hashes and
   more, only the runs whose first hash has lower end bits than the next two.
   Lines meet if any band agrees.  At a similarity of 0.8, 0.995 of pairs do,
   above it more; sets of under 32 windows cannot miss each other.
4. Each line that meets another is read again for the size of its set and its
   64 smallest hashes.  Lines that meet are linked if the exact Jaccard
   similarity of their shingle sets is 0.8 or more.  Where that leaves a band in several
   components, the pairs across them go whose set sizes rule the similarity
   out, whose sets' parities in 1024 bits differ in more bits than the sets may
   in hashes, or whose smallest hashes agree more than four standard deviations
   less often than those of a pair at 0.8 would; the others are compared as well.
5. Distributed union-find joins the links; of each component the line with
   the smallest (doc_id, position) stays.

A band holds four different shingles, so frequent ones bring few lines together,
however many lines there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm import graph
from gatecast.llm.store import broadcast_ids, keep, scratch

NOT_BLANK = r"[^\s\p{Z}]"
SIGNATURE = 40
RUN = 4
SAMPLED = 32  # hashes from which on not every run is a band
SKETCH = 64  # smallest hashes kept of a line that is to be compared
ODD_WORDS = 16  # of 64 bits: parities of the hashes that fall to each bit
MARGIN = 4   # standard deviations below the count expected at the linking similarity
PERCENT = 80
MIN_CHARS = 40  # of a caller that names none; op4 and the pipeline's stage use NO_FLOOR
NO_FLOOR = 1
BROADCAST_LINES = 500_000  # places of some 40 bytes each: 20 MB at most


def _windows(line: str, value: Callable[[Column], Column] = lambda x: F.decode(x, "UTF-32")) -> Column:
    """``value`` of the window at every position, taken of its UTF-32 bytes: of one width, so a position is found without a walk."""
    each = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b) - 31, F.lit(1)), F.lit(4)),
                                 lambda i: value(F.substr(b, i, F.lit(32))))
    return F.get(F.transform(F.array(F.encode(F.col(line), "UTF-32")), each), F.lit(0))


def _bands(signature: str) -> Column:
    """Band keys of a signature, none null and each once.

    Two sets of n and m windows at the linking similarity differ in at most
    (n + m) / 9 of them, which cut the common ones into that many runs and one
    more.  One of four or more is then left, but for n + m of 9 (a run of 2)
    and 11, 13, 18, 20 and 27 (of 3).  Sets of under four link if equal.
    """
    at = lambda i: F.get(signature, F.lit(i))
    low = lambda i: at(i).bitwiseAND(0xFFFF)
    n = F.size(signature)

    def run(i: int, length: int, also: Column) -> Column:
        return F.when((n >= i + length) & also, F.xxhash64(F.lit(length), *[at(i + k) for k in range(length)]))

    runs = [run(i, RUN, (n < SAMPLED) | ((low(i) < low(i + 1)) & (low(i) < low(i + 2)))) for i in range(SIGNATURE - RUN + 1)]
    runs += [run(i, 3, (n >= 5) & (n <= 15)) for i in range(13)]
    runs += [run(i, 2, (n >= 4) & (n <= 5)) for i in range(4)]
    whole = F.when(n < RUN, F.xxhash64(F.lit(0), signature))
    return F.array_except(F.array(whole, *runs), F.array(F.lit(None).cast("long")))


def _marked_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that takes part: where it is, its 96-bit hash and its bands."""
    lines = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")))
             .select("doc_id", "text_hash", "pos", F.trim("col").alias("line"))
             .where((F.char_length("line") >= min_chars) & F.col("line").rlike(NOT_BLANK)))
    hashed = lines.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.crc32("line").alias("h2"),
                          F.sort_array(_windows("line", lambda x: F.xxhash64(x))).alias("hashes"))
    # mostly the first few hold enough different ones; a repetitive line needs all
    few = hashed.withColumn("few", F.array_distinct(F.slice("hashes", 1, 2 * SIGNATURE)))
    enough = (F.size("few") >= SIGNATURE) | (F.size("hashes") <= 2 * SIGNATURE)
    signature = F.slice(F.when(enough, F.col("few")).otherwise(F.array_distinct("hashes")), 1, SIGNATURE)
    signed = few.select("doc_id", "text_hash", "pos", "h1", "h2", signature.alias("signature"))
    # the lambda keeps the bands out of whole-stage code: one method of that length is never compiled
    h2 = F.get(F.transform(F.array("h2"), lambda x: x), F.lit(0)).alias("h2")
    return signed.select("doc_id", "text_hash", "pos", "h1", h2, _bands("signature").alias("bands"))


def _sketch(line: str) -> Column:
    """Struct of the number of distinct windows and the SKETCH smallest of their hashes."""
    hashes = F.array_distinct(F.sort_array(_windows(line, lambda x: F.xxhash64(x))))
    return F.struct(F.size(hashes).alias("n"), F.slice(hashes, 1, SKETCH).alias("low"))


def _near(a: str, b: str) -> Column:
    """Whether sketches ``a`` and ``b`` leave the similarity possible; exact if they hold both sets.

    The larger set's smallest hashes are a random draw from it, so those also
    in the other set are its share of the intersection, give or take.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    common = F.size(F.array_intersect(f"{a}.low", f"{b}.low"))
    large = F.greatest(n, m)
    share = (n + m) * PERCENT / (100 + PERCENT) / large
    least = F.lit(SKETCH) * share - MARGIN * F.sqrt(SKETCH * share * F.greatest(1 - share, F.lit(0)))
    whole = large <= SKETCH
    return ((F.least(n, m) * 100 >= large * PERCENT)
            & F.when(whole, common * (100 + PERCENT) >= (n + m) * PERCENT).otherwise(common >= least))


def _odd(lines: DataFrame) -> DataFrame:
    """Rows ``(row, odd)`` of ``lines(row, line)``: of each bit whether an odd number of the line's distinct hashes fall to it."""
    hashes = lines.select("row", F.explode(F.array_distinct(_windows("line", lambda x: F.xxhash64(x)))).alias("h"))
    placed = hashes.select("row", F.expr(f"int(pmod(h, {ODD_WORDS}))").alias("word"), F.expr("shiftleft(1L, int((h >> 32) & 63))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")) for k in range(ODD_WORDS)]
    return placed.groupBy("row").agg(F.array(*words).alias("odd"))


def _differ_little(a: str, b: str) -> Column:
    """Whether the parities of ``a`` and ``b`` leave the similarity possible: a hash in one set only flips one bit, so no linked pair goes."""
    at = lambda x, i: F.get(F.col(f"{x}.odd"), F.lit(i))
    flipped = sum((F.bit_count(at(a, i).bitwiseXOR(at(b, i))) for i in range(ODD_WORDS)), F.lit(0))
    return flipped * (100 + PERCENT) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - PERCENT)


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose lines, with sets of ``n_a`` and ``n_b`` windows, reach the exact similarity, on 64-bit hashes."""
    # sets of too different sizes need no intersection
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    a, b = (_windows(c, lambda x: F.xxhash64(x)) for c in ("line_a", "line_b"))
    close = F.size(F.array_intersect(a, b)) * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT
    return pairs.where(sized & close).select("a", "b")


def _read_again(texts: DataFrame, lines: DataFrame, used: DataFrame) -> DataFrame:
    """Rows ``(row, line, sketch)`` of the rows ``used`` of ``lines``, found in their texts."""
    where = lines.select("row", "doc_id", "text_hash", "pos").join(broadcast_ids(used), "row")
    places = keep(where.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "row")).alias("at")).toDF("d", "t", "at"), "places")
    # the lines' places, at most BROADCAST_LINES of them, or else the texts are shuffled
    wanted = F.broadcast(places) if used.count() <= BROADCAST_LINES else places
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")))
    part = F.split("text", "\n")
    each = found.select(F.explode(F.transform("at", lambda x: F.struct(
        x["row"].alias("row"), F.trim(F.get(part, x["pos"])).alias("line")))).alias("x"))
    once = each.select("x.row", "x.line").dropDuplicates(["row"])  # a repeated document has its lines twice
    return keep(once.select("row", "line", _sketch("line").alias("sketch")), "candidates")


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines that go: rows ``(doc_id, text_hash, removed)``, removed being an array of line positions.

    ``text_hash`` is xxhash64 of the text; it tells apart different texts of
    one doc_id.  Repeated rows of a document get the same verdict.
    """
    with scratch(docs.sparkSession):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        lines = keep(_marked_lines(texts, min_chars).withColumn("row", F.monotonically_increasing_id()), "lines")
        nodes = keep(lines.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("n")), "nodes")
        again = keep(lines.select("row", "h1", "h2").join(nodes.where("n > 1"), ["h1", "h2"]).where("row <> node").select("row"), "again")
        unique = lines.join(broadcast_ids(again), "row", "left_anti").select(F.col("row").alias("node"), "bands")
        shared = graph.shared_buckets(unique.select("node", F.explode("bands").alias("key")))
        met = _read_again(texts, lines, keep(shared.select(F.col("node").alias("row")).distinct(), "used"))

        def marks(of: DataFrame) -> DataFrame:
            some = met.join(broadcast_ids(of.toDF("row")), "row")
            mark = F.struct("sketch.n", "sketch.low", "odd").alias("mark")
            return some.join(_odd(some.select("row", "line")), "row").select(F.col("row").alias("node"), mark)

        def verify(pairs: DataFrame) -> DataFrame:
            line = met.select("row", F.col("sketch.n").alias("n"), "line")
            return _linked(pairs.join(line.toDF("a", "n_a", "line_a"), "a").join(line.toDF("b", "n_b", "line_b"), "b"))

        comp = graph.link_buckets(shared, verify, marks, lambda a, b: _differ_little(a, b) & _near(a, b))
        several = (nodes.join(comp, "node", "left").where("n > 1 or root is not null")
                   .select("h1", "h2", F.coalesce("root", "node").alias("root")))
        member = lines.select("doc_id", "text_hash", "pos", "h1", "h2").join(several, ["h1", "h2"])
        place = F.struct("doc_id", "pos", "text_hash")
        members = keep(member.select("root", place.alias("place")), "members")
        first = members.groupBy("root").agg(F.min("place").alias("first"))
        gone = members.join(first, "root").where("place <> first")
        found = gone.groupBy("place.doc_id", "place.text_hash").agg(F.sort_array(F.collect_set("place.pos")).alias("removed"))
        return keep(found, "removed", lasting=True)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with one line per component of equal or similar lines.

    ``docs`` needs doc_id (long) and text; the other columns stay, and
    ``n_chars``, if there, follows the new text.  Lines shorter than
    ``min_chars`` stay, as do null and empty texts.  Repeated rows of one
    document count as one and stay alike.  A null doc_id comes first in the
    order.  Lines of white space only stay.  With ``drop_emptied``, documents of which nothing but blank
    remains after lines went are dropped.  An empty table stays empty.
    """
    gone = duplicate_lines(docs, min_chars).toDF("__doc", "__hash", "__removed")
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))
                       & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(rest))
    if drop_emptied:
        out = out.where("__removed is null or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(kind)))
    return out.select(*docs.columns)
