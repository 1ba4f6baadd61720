"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Words are lower-cased runs of letters and digits; shingles are five words (all
words of a shorter text). A document leaks an item if it holds at least 0.8 of the item's distinct
shingles, however long the document is.

Items are partitioned by their number of shingles, in powers of two. An item's
signature is its m least shingles in the order of (items that share the
shingle, hash), where m follows from its partition's upper bound u: a document
that holds 0.8 of u shingles lacks fewer than m = u - ceil(0.8 u) + 1 of
them, so it can't lack a whole signature. A document probes those
partitions whose items are small enough for it. What shares a signature
value is a candidate and is verified by counting the very shingles.

Null and empty texts have no shingles: they leak nothing and, as items, are
leaked by nothing. Rows are matched one by one, whatever their ids: every text
of an item id is an item of its own, and every document row is held against it.
A pair of ids is returned once, for the text that is contained most, then has most
shingles. Null ids, of documents and items, are kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_text

SIZE = 5
#: Containment, as a fraction of integers.
LEAST, OF = 4, 5
#: Bytes of benchmark text up to which its signatures and shingles are broadcast; beyond, they are shuffled.
BROADCAST_BYTES = 8 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: str, size: int) -> Column:
    """A hash for each shingle of an array column of words, repeats included."""
    last = f"size({words}) - {size - 1}"
    each = f"transform({words}, w -> xxhash64(w))"
    parts = ", ".join(["x", *(f"hs[i + {k}]" for k in range(1, size))])
    long_ = f"transform(slice(hs, 1, {last}), (x, i) -> xxhash64({parts}))"
    # An array of one lets hs be named once.
    named = f"flatten(transform(array({each}), hs -> {long_}))"
    return F.expr(f"CASE WHEN size({words}) = 0 THEN array() WHEN size({words}) < {size} THEN array(xxhash64(-1L, array_join({words}, ' '))) ELSE {named} END")


def _shingles(words: str, size: int) -> str:
    """SQL for the distinct shingles as text."""
    return f"CASE WHEN size({words}) = 0 THEN array() WHEN size({words}) < {size} THEN array(array_join({words}, ' ')) ELSE array_distinct(transform(sequence(1, size({words}) - {size - 1}), i -> array_join(slice({words}, i, {size}), ' '))) END"


def signatures(items: DataFrame, size: int = SIZE) -> DataFrame:
    """sig, item, signature, least_size (shingles that a document needs) for every value of the items' signatures, by size partition; items: item (a key), words."""
    hashed = items.select("item", F.array_distinct(_hashes("words", size)).alias("hs")).where("size(hs) > 0")
    each = hashed.select("item", F.size("hs").alias("q"), F.explode("hs").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("shared"))
    ordered = each.join(shared, "h").groupBy("item", "q").agg(F.array_sort(F.collect_list(F.struct("shared", "h"))).alias("order"))
    upper = F.expr("cast(pow(2, ceil(log2(q))) as int)")
    return (
        ordered.withColumn("upper", upper)
        .withColumn("m", F.expr(f"upper - cast(ceil({LEAST} * upper / {OF}) as int) + 1"))
        .select("item", F.expr(f"cast(ceil({LEAST} * (upper / 2) / {OF}) as int)").alias("least_size"), F.expr("transform(slice(order, 1, m), x -> x.h)").alias("signature"))
        .select(F.explode("signature").alias("sig"), "item", "signature", "least_size")
    )


def _pairs(docs: DataFrame, benchmark: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """Of docs (doc_id, own: a hash of the text, text), every row with each item that it leaks: doc_id, own, item_id, n_shingles, n_shared."""
    items = id_text(benchmark, "item_id", "text", binary=False).select(F.col("doc_id").alias("item_id"), _words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).groupBy("item_id", "words").agg(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull(), "words").alias("item"))
    texts = items.select("item", "item_id", F.expr(_shingles("words", size)).alias("item_shingles")).withColumn("q", F.size("item_shingles"))
    marks = signatures(items, size)
    small = (benchmark.agg(F.sum(F.octet_length(benchmark["text"].cast("string"))).alias("b")).first()["b"] or 0) <= broadcast_bytes
    spread = F.broadcast if small else (lambda df: df)

    hashed = docs.select("doc_id", "own", _words(F.col("text")).alias("words")).select("doc_id", "own", "words", F.array_distinct(_hashes("words", size)).alias("hs"))
    # explode() would have the optimizer test the array's size next to the scan, by making the array once more.
    probes = hashed.select("doc_id", "own", "words", "hs", F.size("hs").alias("n"), F.explode_outer("hs").alias("h"))
    # Nor may it test the size for null there.
    near = (F.col("h") == F.col("sig")) & (F.coalesce("n", F.lit(0)) >= F.col("least_size"))
    if small:  # no row is moved: the words stand beside what is looked up, and an item's first value that the row holds stands for the others
        met = probes.join(spread(marks), near).where(F.element_at(F.array_intersect("signature", "hs"), 1) == F.col("h"))
        candidates = met.select("doc_id", "own", "words", "item")
    else:
        found = probes.select("doc_id", "own", "n", "h").join(marks, near).select(F.col("doc_id").alias("found"), F.col("own").alias("found_own"), "item").distinct()
        same = hashed["doc_id"].eqNullSafe(found["found"]) & (hashed["own"] == found["found_own"])
        candidates = hashed.join(found, same).select("doc_id", "own", "words", "item")
    shared = F.expr(f"size(array_intersect(item_shingles, {_shingles('words', size)}))")
    verified = candidates.join(spread(texts), "item").select("doc_id", "own", "item_id", F.col("q").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return verified.where(F.col("n_shared") * OF >= F.col("n_shingles") * LEAST)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared: each pair with n_shared of 0.8 n_shingles at least, once."""
    rows = id_text(docs, id_col, text_col, binary=False).withColumn("own", F.xxhash64("text"))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("part"), "n_shingles", "n_shared")).alias("best")
    return _pairs(rows, benchmark, size, broadcast_bytes).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that leak no item, with all their columns; each is judged by its own text, whatever other rows have its id."""
    rows = id_text(docs, id_col, text_col, binary=False).withColumn("own", F.xxhash64("text"))
    found = _pairs(rows, benchmark, SIZE, BROADCAST_BYTES).select(F.col("doc_id").alias("__leak"), F.col("own").alias("__text")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(found["__leak"]) & (F.xxhash64(docs[text_col].cast("string")) == found["__text"])
    return docs.join(found, same, "left_anti")
