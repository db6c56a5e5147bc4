"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, marks and digits, lower-cased. A window is as many words of a document as an item has, placed where a shingle
of five words of the document lines up with one of an item; a window without any such shingle cannot be similar. A place beyond the document's
edge is moved to the edge, and a document shorter than the item is one window, so items cut at an edge are found. Each window and each item
gets a 128-bit SimHash of its shingles. The fingerprints are cut into 8 blocks of 16 bits. Of two that differ in at most 31 bits, some block differs
in at most 3, as 8 blocks of 4 would make 32. So each item is entered under all values within 3 flips of each of its blocks, 5,576 in all, each
window is looked up under its own 8, and all items of its size within the radius are found; of two unrelated prints a block agrees with a
chance of 1 in 94. At a similarity of 0.8 SimHashes differ by 19 bits on average with a deviation of 4.
What is found is verified by the exact weighted similarity of the shingles: a shingle weighs as often as it occurs.

A window of a text grows with its item, whatever the text, so very long texts only have more of them.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

WORDS = 5  # of a shingle; fewer in items that have fewer
BLOCKS, BLOCK_BITS = 8, 16  # 128 bits
FLIPS = 3  # of a block, under which items are entered
RADIUS = BLOCKS * (FLIPS + 1) - 1
PERCENT = 80
BROADCAST_SHINGLES = 500_000  # of items, 16 bytes each; more are joined by a shuffle


def words_of(text: Column) -> Column:
    """Words in order; an empty array for NULL and for texts without any."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(parts, lambda x: x != "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by position; none if there are fewer words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)]))


def simhash(df: DataFrame, shingles: str = "shingles", out: str = "fingerprint") -> DataFrame:
    """``df`` with the blocks of the fingerprint. Bit b is set if most of the shingles' hashes have it; two hashes of 64 bits per shingle."""
    halves = ["_half_0", "_half_1"]
    hashed = lambda salt: F.transform(shingles, lambda x: F.xxhash64(F.lit(salt), x))
    rows = df.withColumns({h: hashed(salt) for salt, h in enumerate(halves)})

    def bit(b: int) -> Column:
        ones = F.aggregate(halves[b // 64], F.lit(0), lambda n, h: n + F.getbit(h, F.lit(b % 64)).cast("int"))
        return F.when(2 * ones > F.size(shingles), 1).otherwise(0)

    def block(k: int) -> Column:
        bits = [bit(k * BLOCK_BITS + j) for j in range(BLOCK_BITS)]
        return sum((x * (1 << j) for j, x in enumerate(bits[1:], 1)), bits[0])

    return rows.withColumn(out, F.array(*[block(k) for k in range(BLOCKS)])).drop(*halves)


def candidates(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (window, _item) of one size whose fingerprints have a block that differs in at most ``FLIPS`` bits; holds all pairs within the radius.

    ``prints`` has window, size and fingerprint, ``items`` _item, size and fingerprint. The index grows with the items alone.
    """
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda m: F.bit_count(m) <= FLIPS)
    entered = items.select("_item", "size", "fingerprint").distinct().select("_item", "size", F.posexplode("fingerprint").alias("_block", "_own"))
    entered = entered.withColumn("_flip", F.explode(masks)).select("_item", "size", "_block", F.col("_own").bitwiseXOR(F.col("_flip")).alias("_value"))
    looked_up = prints.select("window", "size", F.posexplode("fingerprint").alias("_block", "_value"))
    # a merge join, as the planner cannot know how many rows the flips make
    return looked_up.join(entered.hint("merge"), ["size", "_block", "_value"]).select("window", "_item").distinct()


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two arrays of shingles: common weight by weight of either; a shingle weighs as often as it occurs."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def item_table(benchmark: DataFrame) -> DataFrame:
    """Items that have words: item_id, size, width of their shingles, shingles and fingerprint."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_words")).withColumn("size", F.size("_words")).where("size > 0")
    items = items.withColumn("width", F.least("size", F.lit(WORDS)))
    by_width = F.coalesce(*[F.when(F.col("width") == w, shingles_of(F.col("_words"), w)) for w in range(1, WORDS + 1)])
    return items.withColumn("shingles", by_width).drop("_words")


def windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Item-sized windows (doc, texthash, size, width, start, length, shingles) where a shingle of the document lines up with an item's.

    ``size`` is the item's, ``length`` that of the window, which is less only if the whole document is.
    """
    spots = items.select("width", "size", F.posexplode("shingles").alias("_at", "hash"))
    spots = stored(spots.groupBy("hash", "width").agg(F.collect_set(F.struct("_at", "size")).alias("_spots")), "leak-spots")
    small = spots.count() <= BROADCAST_SHINGLES
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most five
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("texthash"), words_of(F.col(text_col)).alias("_words"))
    found = None
    for w in sorted(widths):
        own = spots.where(F.col("width") == w).drop("width")
        hits = rows.select("doc", "texthash", F.size("_words").alias("_n"), F.posexplode(shingles_of(F.col("_words"), w)).alias("_pos", "hash"))
        hits = hits.join(F.broadcast(own) if small else own, "hash").select("doc", "texthash", "_n", "_pos", F.explode("_spots").alias("_s"))
        start = F.greatest(F.lit(0), F.least(F.col("_pos") - F.col("_s._at"), F.col("_n") - F.col("_s.size")))
        placed = hits.select("doc", "texthash", F.lit(w).alias("width"), start.alias("start"), F.col("_s.size").alias("size"))
        found = placed if found is None else found.unionByName(placed)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc {docs.schema[id_col].dataType.simpleString()}, texthash long, width int, start int, size int, length int, shingles array<long>")
    starts = stored(found.distinct(), "leak-starts")
    texts = starts.select("texthash").distinct()
    words = docs.select(F.xxhash64(text_col).alias("texthash"), words_of(F.col(text_col)).alias("_words")).join(
        F.broadcast(texts) if texts.count() <= BROADCAST_SHINGLES else texts, "texthash", "left_semi")
    kinds = starts.select("texthash", "width", "start", "size").distinct()
    cut = kinds.join(words, "texthash").withColumn("_own", F.slice("_words", F.col("start") + 1, F.col("size")))
    by_width = F.coalesce(*[F.when(F.col("width") == w, shingles_of(F.col("_own"), w)) for w in range(1, WORDS + 1)])
    made = cut.select("texthash", "width", "start", "size", F.size("_own").alias("length"), by_width.alias("shingles")).dropDuplicates(["texthash", "width", "start", "size"])
    return starts.join(made, ["texthash", "width", "start", "size"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, texthash, item_id, start, size, similarity): for each document and item that it holds, the most similar window, the first of equals, and its words.

    NULL, empty and word-less texts and items match nothing. A document's NULL id is an id like any other; rows that repeat id and text
    give one row per item. Items that repeat an id count as one item, those with a NULL id likewise. Empty tables give an empty result.
    Other columns are not read.
    """
    items = stored(simhash(stored(item_table(benchmark.select("item_id", "text")), "leak-items")), "leak-fingerprints")
    spans = stored(windows(docs, items, id_col, text_col), "leak-windows")
    prints = simhash(spans.groupBy("size", "shingles").agg(F.count("*").alias("_n")).drop("_n"))
    prints = stored(prints.withColumn("window", F.xxhash64("size", "shingles")), "leak-prints")
    pairs = candidates(prints, items.withColumn("_item", F.xxhash64("size", "shingles")))
    sides = pairs.join(prints.select("window", "shingles", "fingerprint"), "window").join(
        items.select(F.xxhash64("size", "shingles").alias("_item"), F.col("shingles").alias("_other"), F.col("fingerprint").alias("_print")).dropDuplicates(["_item"]), "_item")
    close = sides.where(distance(F.col("fingerprint"), F.col("_print")) <= RADIUS).withColumn("similarity", similarity(F.col("shingles"), F.col("_other")))
    verified = close.where(F.col("similarity") * 100 >= percent).select("window", "_item", "similarity")
    named = verified.join(items.select("item_id", F.xxhash64("size", "shingles").alias("_item")), "_item")
    where = spans.withColumn("window", F.xxhash64("size", "shingles")).join(named, "window")
    best = F.min(F.struct(-F.col("similarity"), F.col("start"), F.col("length").alias("size")))
    out = where.groupBy("doc", "texthash", "item_id").agg(best.alias("_best"))
    return out.select("doc", "texthash", "item_id", "_best.start", "_best.size", (-F.col("_best.col1")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark. All columns pass through; rows with a NULL id and empty texts stay unless they hold one."""
    bad = leaks(docs, benchmark, id_col, text_col).select("texthash").distinct()
    rows = docs.withColumn("_hash", F.xxhash64(text_col))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_SHINGLES else bad
    return rows.join(bad, F.col("_hash") == F.col("texthash"), "left_anti").drop("_hash")
