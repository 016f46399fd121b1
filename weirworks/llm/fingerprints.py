"""SimHash fingerprints in DataFrame operations only.

The terms of a text are its runs of ``WIDTH`` words (the whole text if shorter). Each term's 64-bit hash votes on every
bit, weighted by how often the term occurs; a bit is set if more than half of the weight votes for it. The votes of bits
k and k + 32 are summed in the halves of one long, so 32 sums in generated code make the fingerprint.

Fingerprints within a Hamming radius r are found in permuted block tables: the 64 bits are cut into ``r + KEPT`` blocks,
and two fingerprints that differ in r bits agree in some ``KEPT`` whole blocks, so every choice of ``KEPT`` blocks is a
table keyed on those blocks. A key has about 64 * KEPT / (r + KEPT) bits, so its rows stay few as the corpus grows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 3
RADIUS = 3
KEPT = 3
LOW = (1 << 32) - 1


def terms(text: Column, width: int = WIDTH) -> Column:
    """The hashes of all runs of ``width`` words, repeats kept; of the whole text if it has fewer words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, runs(w)).otherwise(F.array(F.xxhash64(w)))), 1)


def fingerprint(rows: DataFrame, keys: list[str], text: Column, width: int = WIDTH) -> DataFrame:
    """``keys`` and ``simhash`` (long), one row per distinct value of ``keys``; equal texts get equal fingerprints."""
    half = F.lit((1 << 32) + 1)
    votes = rows.select(*keys, F.explode(terms(text, width)).alias("__term")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.shiftrightunsigned("__term", k).bitwiseAND(half)).alias(f"__v{k}") for k in range(32)])
    bits = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"__v{k}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(f"__v{k}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("__n"), F.lit(1 << k)).otherwise(F.lit(0)))
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("__n"), F.lit((1 << (k + 32)) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0)))
    return votes.select(*keys, bits.alias("simhash"))


def likeness(a: Column, b: Column) -> Column:
    """The share of bits in which two fingerprints agree, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _tables(column: str, radius: int, kept: int) -> Column:
    """One (table, key) for each choice of blocks."""
    cuts = [round(64 * i / (radius + kept)) for i in range(radius + kept + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(radius + kept), kept)):
        mask = sum(((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in chosen)
        keys.append(F.struct(F.lit(t).alias("t"), F.col(column).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("k")))
    return F.explode(F.array(*keys))


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """Pairs (query, found) of distinct fingerprints, columns ``simhash`` of both inputs, that differ in at most
    ``radius`` bits. Equal fingerprints are one entry of a table, so large groups of copies meet as a single row."""
    a = queries.select(F.col("simhash").alias("query")).distinct().select("query", _tables("query", radius, kept).alias("key")).select("query", "key.t", "key.k")
    b = corpus.select(F.col("simhash").alias("found")).distinct().select("found", _tables("found", radius, kept).alias("key")).select("found", "key.t", "key.k")
    near = a.join(b, ["t", "k"]).where(F.bit_count(F.col("query").bitwiseXOR(F.col("found"))) <= radius)
    return near.select("query", "found").distinct()


def following(ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """(column, next): the next larger value, after the largest the smallest. Sorted by ranges, so no task sees all."""
    spread = ids.select(column).where(F.col(column).isNotNull()).distinct()
    count = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(count, column).withColumn("__part", F.spark_partition_id())
    firsts = ranged.groupBy("__part").agg(F.min(column).alias("__first"))   # one row per range
    order = Window.orderBy("__part")
    links = firsts.select("__part", F.coalesce(F.lead("__first").over(order), F.min("__first").over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("__after"))
    lead = F.lead(column).over(Window.partitionBy("__part").orderBy(column))
    return ranged.withColumn("__lead", lead).join(links, "__part").select(column, F.coalesce("__lead", "__after").alias("next"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next, and for documents whose id is divisible by 100 ``n_near``: how many other documents lie within ``radius``.

    The edited text ends with the start of the next document's text. A null text counts as empty; empty texts share one
    fingerprint; doc_id names a document, so repeated rows give one row; rows without doc_id are left out.
    """
    from weirworks.sources.workdir import written
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = written(texts.select("doc_id", F.length("text").cast("long").alias("n_chars")).distinct(), "fingerprint-sizes")
    after = written(following(sized), "fingerprint-next")
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    asked = sized.join(after, "doc_id").select(F.col("next").alias("doc_id"), F.col("doc_id").alias("before"), cut.alias("need"))
    heads = texts.join(asked, "doc_id").select(F.col("before").alias("doc_id"), F.expr("substring(text, 1, need)").alias("head"))
    both = texts.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.col("head"))
    both = both.select("doc_id", "n_chars", "text", edited.alias("edited"))
    kinds = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("v"))
    marks = written(fingerprint(kinds.select("doc_id", "n_chars", "edited_sha256", "v.kind", "v.body"), ["doc_id", "n_chars", "edited_sha256", "kind"], F.col("body")), "fingerprint-marks")
    wide = marks.groupBy("doc_id", "n_chars", "edited_sha256").agg(F.max(F.expr("CASE WHEN kind = 0 THEN simhash END")).alias("own"), F.max(F.expr("CASE WHEN kind = 1 THEN simhash END")).alias("changed"))
    plain = marks.where("kind = 0").select("doc_id", "simhash")
    pairs = within_radius(plain.where("doc_id % 100 = 0"), plain, radius)
    copies = plain.groupBy(F.col("simhash").alias("found")).count()
    near = pairs.join(copies, "found").groupBy("query").agg((F.sum("count") - 1).alias("n_near"))
    return (wide.join(after, "doc_id").join(plain.select(F.col("doc_id").alias("next"), F.col("simhash").alias("followed")), "next")
            .join(near, F.col("own") == F.col("query"), "left")
            .select("doc_id", "n_chars", "edited_sha256", F.lower(F.lpad(F.hex("own"), 16, "0")).alias("fingerprint"),
                    F.lower(F.lpad(F.hex("changed"), 16, "0")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                    likeness(F.col("own"), F.col("followed")).alias("near_next"), F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near")))
