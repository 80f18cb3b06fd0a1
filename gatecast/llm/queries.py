"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.llm import (bpe_codec, html_extract, language_id, line_dedup, merkle, mixing, ngram_join, quality, resampling,
                          sentencepiece_codec, sharding, topk, toxicity)
from gatecast.llm.store import doc_bucket, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets reach a similarity of 0.9."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
           THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e
      UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op4_line_dedup(spark, sf_dir):
    """Documents after fuzzy line dedup: what is left of each text."""
    docs = table(spark, sf_dir, "documents")
    left = line_dedup.dedup_lines(docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines")),
                                  min_chars=line_dedup.NO_FLOOR)
    return left.select("doc_id", "n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_left"), "text")


@query
def op7_toxicity(spark, sf_dir):
    """A toxicity score for every document, learnt from the labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(doc_bucket("doc_id", 4) != 2))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (doc_bucket("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


MIX_PLAN = mixing.Plan(
    domains=[("^src[0-4]$", "web"), ("^src[5-9]$", "news"), ("^src1[0-4]$", "forum")],
    domain_weights={"web": 3, "news": 2, "forum": 2, "other": 3}, lang_weights={"en": 5, "de": 3, "fr": 2, "es": 4})


@query
def op8_mixing(spark, sf_dir):
    """How often each document is taken when sources are mixed to target weights."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), MIX_PLAN)
    return mixed.select("doc_id", "mix.*")


_FILL = """
{name}_o AS (
  SELECT *, budget - coalesce(sum(supply) OVER b, 0)::BIGINT AS budget_left,
         (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER b, 0))::BIGINT AS weight_left
  FROM {source} WINDOW b AS (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {child}
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (
  SELECT *, supply * weight_left <= weight * budget_left AS fits FROM {name}_o),
{name} AS (
  SELECT *, CASE WHEN fits THEN supply ELSE weight * max(budget_left) FILTER (NOT fits) OVER (PARTITION BY {parent})
              // max(weight_left) FILTER (NOT fits) OVER (PARTITION BY {parent}) END::BIGINT AS given FROM {name}_f)"""

ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, 'none'), '^src[0-4]$') THEN 'web'
                      WHEN regexp_matches(coalesce(source, 'none'), '^src[5-9]$') THEN 'news'
                      WHEN regexp_matches(coalesce(source, 'none'), '^src1[0-4]$') THEN 'forum' ELSE 'other' END AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 3 * sum(n_tokens)::BIGINT AS supply FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(supply)::BIGINT AS supply, 0 AS top,
              CASE domain WHEN 'web' THEN 3 WHEN 'news' THEN 2 WHEN 'forum' THEN 2 ELSE 3 END AS weight,
              (SELECT sum(tokens)::BIGINT * 4 // 5 FROM leaf) AS budget FROM leaf GROUP BY domain),""" + _FILL.format(
    name="l1", source="n1", parent="top", child="domain") + """,
n2 AS (SELECT a.domain, a.lang, sum(a.supply)::BIGINT AS supply, any_value(l1.given) AS budget,
              CASE a.lang WHEN 'en' THEN 5 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 WHEN 'es' THEN 4 ELSE 1 END AS weight
       FROM leaf a JOIN l1 USING (domain) GROUP BY ALL),""" + _FILL.format(
    name="l2", source="n2", parent="domain", child="lang") + """,
n3 AS (SELECT a.*, 1 AS weight, l2.given AS budget FROM leaf a JOIN l2 USING (domain, lang)),""" + _FILL.format(
    name="l3", source="n3", parent="domain, lang", child="source") + """,
k AS (SELECT d.*, l3.tokens AS leaf_tokens, l3.given AS leaf_budget,
             CASE WHEN l3.tokens > 0 THEN l3.given // l3.tokens ELSE 0 END AS epochs,
             CASE WHEN l3.tokens > 0 THEN l3.given % l3.tokens ELSE 0 END AS rest
      FROM d JOIN l3 USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
             ORDER BY md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'none'))) AS run FROM k)
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget,
       (epochs + CASE WHEN leaf_tokens > 0 AND run <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
"""


@query
def op10_sentencepiece(spark, sf_dir):
    """The ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    return coded.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids",
                        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


@query
def op2_sharding(spark, sf_dir):
    """All documents dealt to 24 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query
def op3_quality_rules(spark, sf_dir):
    """Plain counts and the verdict of the log-likelihood ratio for every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query
def op6_language_id(spark, sf_dir):
    """The language of every document, learnt outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, docs.where(doc_bucket("doc_id", 3) != 1))
    return found.select("doc_id", (doc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op9_topk_search(spark, sf_dir):
    """The 20 highest inner products of every 20th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLE["op9_topk_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op11_bpe_codec(spark, sf_dir):
    """Digests of every whole text's ids and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.decode(bpe_codec.encode(docs).drop("text"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


# crc32 of a string, bit by bit: every byte is followed by seven zeros, each step takes one in and shifts by a bit
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    regexp_extract_all(hex(encode({0})), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)"""


def _crc32(value: str) -> str:
    return f"xor({_CRC.format(value)}, 4294967295)"


@query
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether it verifies after tampering."""
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def _cell(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, {_LEAF.format(_cell("text"))} AS leaf,
         {_LEAF.format(_cell("tampered"))} AS shown
  FROM (SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents)),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT g, 0 AS lv, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l
      UNION ALL
      SELECT g, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, lv, i // 3),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, i, subroot AS h, count(*) OVER () AS n FROM s
      UNION ALL
      SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, i // 3),
run AS (SELECT g, lv, i // 3 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
top AS (SELECT lv, i // 3 AS p, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
path AS (
  SELECT l.g, l.i, run.lv AS step, (l.i // (3 ** run.lv)::BIGINT) % 3 AS k, hs FROM l JOIN run ON run.g = l.g AND run.p = l.i // (3 ** (run.lv + 1))::BIGINT
  UNION ALL
  SELECT l.g, l.i, 1000 + top.lv, (s.i // (3 ** top.lv)::BIGINT) % 3, hs FROM l JOIN s USING (g) JOIN top ON top.p = s.i // (3 ** (top.lv + 1))::BIGINT),
sib AS (SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY step) AS step, array_to_string(hs[1:k], '') AS a, array_to_string(hs[k + 2:], '') AS b FROM path),
proof AS (SELECT g, i, sha256(string_agg(a || b, '' ORDER BY step)) AS proof_sha256, count(*) AS steps FROM sib GROUP BY ALL),
f AS (SELECT g, i, 0 AS step, shown AS h FROM l
      UNION ALL
      SELECT f.g, f.i, sib.step, sha256(sib.a || f.h || sib.b) FROM f JOIN sib ON sib.g = f.g AND sib.i = f.i AND sib.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM l JOIN s USING (g) LEFT JOIN proof ON proof.g = l.g AND proof.i = l.i
JOIN f ON f.g = l.g AND f.i = l.i AND f.step = coalesce(proof.steps, 0)
"""


@query
def op13_importance_resampling(spark, sf_dir):
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's distribution of hashed words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_importance_resampling"] = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
m AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT r, unnest(ws) AS w FROM w),
k AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM m)),
s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM m JOIN k USING (w) GROUP BY bucket),
g AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM m) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
y AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS h FROM w LEFT JOIN x USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM y),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM o
"""
