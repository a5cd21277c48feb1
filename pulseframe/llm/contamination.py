"""Benchmark passages in documents: SimHash of item-sized windows, exact verification.

Words are cut at white space, in lower case; shingles are five words, or the whole text of
an item or document that has fewer. A window has as many words as a benchmark item and
stands where a shingle of such an item puts it: shingle p of a document equal to shingle j
of an item of L words gives the window of L words from p - j, moved inside the document. A
window without any shingle of an item has similarity zero with it, so it is no candidate.

Windows and items that share a shingle are verified by the weighted Jaccard similarity of
their shingles as multisets. A shingle that the texts of k items share weighs 1 / k, any
other 1; items of equal words are one text. The distance of their 64-bit SimHash
fingerprints is given, and refuses pairs only if a radius is asked for: no radius is sure
to hold every pair of a similarity.

Only DataFrame functions are used. Defined results: null or empty texts and items match
nothing; repeated rows match alike; a null id is kept as null, of documents and of items;
an item is its id and words, so different texts of one id give a row each; ties of
similarity go to the earlier window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import write_stage

SHINGLE = 5
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    white = " \t\n\x0b\x0c\r"
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(white))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingles(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """keep, p, h: position and hash of each shingle of the word column."""
    n = F.size(words)
    parts = [F.slice(words, k + 1, F.greatest(n - SHINGLE + 1, F.lit(0))) for k in range(SHINGLE)]
    long_ = df.where(n >= SHINGLE).select(*keep, F.posexplode(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(parts)])).alias("p", "s"))
    long_ = long_.select(*keep, "p", F.xxhash64(*[F.col("s")[f"w{k}"] for k in range(SHINGLE)]).alias("h"))
    short = df.where((n > 0) & (n < SHINGLE)).select(*keep, F.lit(0).alias("p"), F.xxhash64(F.lit("short"), F.array_join(words, " ")).alias("h"))
    return long_.unionByName(short)


def fingerprinted(shingled: DataFrame, *key: str) -> DataFrame:
    """key, fp: the bits set in over half of each key's shingle hashes, counted in two 32-bit lanes of 32 sums."""
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES))).alias(f"s{j}") for j in range(32)]
    counted = shingled.groupBy(*key).agg(F.count("*").alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for count, at in ((low, j), (high, 32 + j)):
            one = F.shiftleft(F.lit(1).cast("long"), at)
            bits = bits.bitwiseOR(F.when(2 * count > F.col("n"), one).otherwise(F.lit(0).cast("long")))
    return counted.select(*key, bits.alias("fp"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, n_words, distance, similarity: the best window of each document for each item that it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
    items = items.withColumn("size", F.size("words")).where("size > 0").withColumn("item", F.xxhash64(F.array_join("words", " ")))
    item_ids = write_stage(items.select("item_id", "item").distinct(), "item-ids")
    items = write_stage(items.select("item", "size", "words").dropDuplicates(["item"]), "items")
    of_items = write_stage(shingles(items, "words", "item", "size"), "item-shingles")

    # Where a document holds a shingle of an item of `size` words, and the window that it gives.
    places = of_items.select("h", "size", F.col("p").alias("j")).distinct()
    met = shingles(rows.withColumn("n", F.size("words")), "words", "key", "n").join(places, "h")
    start = F.greatest(F.least(F.col("p") - F.col("j"), F.col("n") - F.col("size")), F.lit(0))
    windows = write_stage(met.select("key", "size", start.alias("start")).distinct(), "windows")
    texts = windows.join(rows.select("key", "words").join(windows.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "key")
    texts = texts.select("key", "size", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    of_windows = write_stage(shingles(texts, "words", "key", "size", "start"), "window-shingles")

    weight = of_items.groupBy("h").agg((F.lit(1.0) / F.countDistinct("item")).alias("w"))
    item_counts = write_stage(of_items.groupBy("item", "size", "h").agg(F.count("*").alias("c")).join(weight, "h"), "item-counts")
    item_total = item_counts.groupBy("item").agg(F.sum(F.col("c") * F.col("w")).alias("item_total"))
    counts = of_windows.groupBy("key", "size", "start", "h").agg(F.count("*").alias("k")).join(weight, "h", "left").fillna(1.0, ["w"])
    counts = write_stage(counts, "window-counts")
    total = counts.groupBy("key", "size", "start").agg(F.sum(F.col("k") * F.col("w")).alias("total"))
    shared = counts.select("key", "size", "start", "h", "k").join(item_counts, ["h", "size"])
    shared = shared.groupBy("key", "size", "start", "item").agg(F.sum(F.least("k", "c") * F.col("w")).alias("shared"))
    both = shared.join(total, ["key", "size", "start"]).join(item_total, "item")
    both = both.withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")))
    near = write_stage(both.where(F.col("similarity") >= least - 1e-12).select("key", "size", "start", "item", "similarity"), "near")

    window = ["key", "size", "start"]
    ours = fingerprinted(of_windows.join(near.select(*window).distinct(), window, "left_semi"), *window)
    theirs = fingerprinted(of_items, "item").withColumnRenamed("fp", "item_fp")
    near = near.join(ours, window).join(theirs, "item").withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    if radius is not None:
        near = near.where(F.col("distance") <= radius)
    best = near.groupBy("key", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("size").alias("n_words"), "distance")).alias("m"))
    ids = rows.select("key", "doc_id")
    return best.join(ids, "key").join(item_ids, "item").select("doc_id", "item_id", (-F.col("m.s")).alias("start"), "m.n_words", "m.distance", "m.similarity")
