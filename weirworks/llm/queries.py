"""The registered queries of the subpackage, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (fingerprints, interpolation, jaccard, language, packing, recompression, repair, sharding, surrogates, tiling,
               toxicity, treap, trie)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query
def op10_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


@query
def op2_language(spark, sf_dir):
    return language.identify_documents(read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.classify_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op5_surrogates(spark, sf_dir):
    return surrogates.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), counted="n_entities")


@query
def op9_tiling(spark, sf_dir):
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op3_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
  ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS doc, doc_id AS reach FROM documents UNION SELECT r.doc, b FROM r JOIN both_ways ON r.reach = a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT doc, min(reach) AS c FROM r GROUP BY 1) m ON m.doc = n.doc_id"""
ORACLES["op7_recompression"] = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS l FROM documents),
x AS (SELECT doc_id, i, array_to_string(l[i:i + 34], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w)),
h AS (SELECT doc_id, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h),
a AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS j FROM w),
t AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.j) AS kept, count(*) AS n FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.j = a.j WHERE g.j IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""


@query
def op3_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@query
def op8_interpolation(spark, sf_dir):
    return interpolation.score_documents(read(spark, sf_dir, "documents"))


@query
def op7_recompression(spark, sf_dir):
    return recompression.without_repeats(read(spark, sf_dir, "documents"))


@query
def op12_repair(spark, sf_dir):
    return repair.tokenize_documents(read(spark, sf_dir, "documents"))


@query
def op13_k2treap(spark, sf_dir):
    return treap.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op13_k2treap"] = f"""
WITH d AS (SELECT doc_id, l, CAST(len(l) AS BIGINT) AS n FROM (SELECT doc_id, {TERMS} AS l FROM documents) WHERE len(l) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM d) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
c AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""


@query
def op11_double_array(spark, sf_dir):
    return trie.conversation_nodes(read(spark, sf_dir, "conversations"))


CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""
ORACLES["op11_double_array"] = f"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(o.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, l[1:d] AS path FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
n AS (SELECT path, d, min(conv_id) AS c, count(*) AS n FROM p GROUP BY path, d),
m AS (SELECT p.conv_id, p.d, n.c, n.n, CASE WHEN p.d = 0 THEN 0 ELSE length(p.path[p.d].text) END AS chars FROM p JOIN n ON n.path = p.path AND n.d = p.d),
k AS (SELECT m.c, m.d, m.n, m.chars, u.c AS parent FROM m LEFT JOIN m AS u ON u.conv_id = m.conv_id AND u.d = m.d - 1 WHERE m.conv_id = m.c),
f AS (SELECT parent AS c, d - 1 AS d, count(*) AS children FROM k WHERE parent IS NOT NULL GROUP BY 1, 2),
j AS (SELECT k.*, coalesce(children, 0) AS children FROM k LEFT JOIN f ON f.c = k.c AND f.d = k.d),
s AS (SELECT m.c, m.d, count(*) FILTER (children = 0) AS leaves, sum((j.n - 1) * j.chars) AS saved FROM j JOIN m ON m.conv_id = j.c AND m.d <= j.d GROUP BY 1, 2),
e AS (SELECT m.c, m.d, sha256(string_agg(CAST(b.conv_id AS VARCHAR), ',' ORDER BY b.conv_id)) AS h FROM b JOIN m ON m.conv_id = b.conv_id AND m.d = len(b.l) GROUP BY 1, 2)
SELECT j.c AS conv_id, CAST(j.d AS BIGINT) AS depth, j.parent AS parent_conv_id, j.n AS n_convs, CAST(j.children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM j JOIN s ON s.c = j.c AND s.d = j.d LEFT JOIN e ON e.c = j.c AND e.d = j.d"""
