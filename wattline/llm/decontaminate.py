"""Benchmark decontamination: short test items inside long documents, by MinHash containment on size partitions.

Only DataFrame and SQL functions. Documents are partitioned by the number of their distinct shingles; a
partition of sizes up to 2**k hashes by one permutation into 2**(k + extra) bins and keeps the least
value of each bin. An item's shingle that is contained in a document is its bin's minimum in the
document with a known probability, which depends on the number of bins for each shingle alone.
Items are partitioned by size too: `extra` is chosen for each size so that the least containment still shares a
minimum with the chance `recall`. Bins are leading bits of a hash, so the sketches of all `extra` are nested, and one
sketch of a document, with the largest `extra` in use, serves all sizes. Sketches of documents and items meet in one join
on those values; pairs found are verified by counting the item's shingles in the whole document.
An item of fewer words than a shingle is a shingle of its own, which only a text of just these words has: its sketch is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattline.llm.common import SHINGLE, SIMILAR, broadcast_rows, stored, text_key

BROADCAST_ROWS = 200_000  # of an item index or a list of candidates; beyond that the join shuffles


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingle_set(words: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of n-word shingles; 1 to n - 1 words are one shingle, none have none."""
    count = F.size(words)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    # single elements, as a slice would copy the whole array for each shingle; beyond the end they are null, which the hash skips
    return F.sort_array(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))))


def extra_bits(least: int, contained: float, recall: float) -> int:
    """Bins for each shingle, as a power of two, so that ceil(least * contained) shared shingles meet with the chance `recall`.

    With c shingles to a bin, a shingle is its bin's minimum with the chance (1 - exp(-c)) / c.
    """
    shared = max(1, math.ceil(least * contained))
    for bits in range(40):
        c = 2.0**-bits
        if 1 - (1 - (1 - math.exp(-c)) / c) ** shared >= recall:
            return bits
    return 40


def bin_minimum(k: Column, extra: Column) -> Column:
    """Whether h is its bin's least value, among sorted hashes: it and the hash before it differ in their first k + extra bits."""
    bits = F.least(k + extra, F.lit(63))
    shift = (64 - bits).cast("int")
    first = [F.call_function("shiftrightunsigned", F.col(c), shift) for c in ("h", "before")]
    return F.col("before").isNull() | (bits > 0) & (first[0] != first[1])


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", words: int = SHINGLE, contained: float = SIMILAR, recall: float = 1 - 1e-6) -> DataFrame:
    """(k1, k2, item_id, n_item, n_found): content keys of texts (see text_key) that hold at least `contained` of an item's distinct shingles.

    Texts are compared as lower-case words without punctuation. Null, empty or wordless texts and items match
    nothing; an item under `words` words is one shingle, which only a text of the same words has. Very long texts are
    sketched whole. An exact share of `contained` counts as enough.
    Repeated items give repeated rows with their ids; repeated texts share a key. An empty table on either side gives no
    rows; other columns of both tables are not looked at.
    """
    k1, k2 = text_key(F.col(text))
    item = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("w"))
    item = item.select("item_id", (F.size("w") < words).alias("short"), shingle_set(F.col("w"), words).alias("s")).withColumn("n_item", F.size("s")).where("n_item > 0")
    by_shared = [extra_bits(i, 1.0, recall) for i in range(1, 65)]  # 64 shared shingles need no extra bins at any sensible recall
    shared = F.ceil(F.col("n_item") * contained - 1e-9)
    extra = F.when(F.col("short"), 0).otherwise(F.element_at(F.array(*map(F.lit, by_shared)), F.least(shared, F.lit(64)).cast("int")))
    item = stored(item.withColumn("extra", extra), "items")
    most = item.agg(F.max("extra")).first()[0]
    if most is None:
        return docs.select(k1.alias("k1"), k2.alias("k2")).limit(0).crossJoin(item.select("item_id", "n_item").limit(0)).withColumn("n_found", F.lit(0).cast("long"))
    flat = item.select("item_id", "n_item", "extra", F.posexplode("s").alias("at", "h"), "s")
    # an item's shingle is its own bin's minimum from this partition on: bins of partition k are leading bits, nested
    before = F.when(F.col("at") > 0, F.element_at("s", F.col("at")))
    same = F.when(before.isNull(), -1).otherwise(64 - F.length(F.bin(F.col("h").bitwiseXOR(before))))
    index = stored(flat.select("item_id", "n_item", "extra", "h", F.greatest(same + 1 - F.col("extra"), F.lit(0)).cast("int").alias("from_k")), "index")
    source = docs.select(F.col(text).alias("t"), k1.alias("k1"), k2.alias("k2")).where(F.col("t").isNotNull())
    split = source.select("k1", "k2", words_of(F.col("t")).alias("w"))  # a column of its own: lambdas would split the text anew for each shingle
    sets = split.select("k1", "k2", shingle_set(F.col("w"), words).alias("s"))
    # never null, or the join's check for nulls would be pushed to the scan, and with it all of the expression
    sets = sets.withColumn("k", F.coalesce(F.ceil(F.log2(F.greatest(F.size("s"), F.lit(1)))).cast("int"), F.lit(0)))
    shifted = F.concat(F.array(F.lit(None).cast("long")), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))))
    mins = sets.select("k1", "k2", "k", F.inline(F.arrays_zip(F.col("s").alias("h"), shifted.alias("before"))))
    mins = mins.where(bin_minimum(F.col("k"), F.lit(most)))
    hits = mins.join(broadcast_rows(index, BROADCAST_ROWS), "h").where((F.col("k") >= F.col("from_k")) & bin_minimum(F.col("k"), F.col("extra")))
    pairs = stored(hits.select("k1", "k2", "item_id").distinct(), "pairs")
    # whole documents of the pairs, and the exact count of each item's shingles in them
    keys = pairs.select("k1", "k2").distinct()
    whole = source.join(broadcast_rows(keys, BROADCAST_ROWS), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    whole = whole.select("k1", "k2", words_of(F.col("t")).alias("w"))
    inside = whole.select("k1", "k2", F.explode(shingle_set(F.col("w"), words)).alias("h")).join(broadcast_rows(index.select("item_id", "n_item", "h"), BROADCAST_ROWS), "h")
    found = inside.groupBy("k1", "k2", "item_id", "n_item").agg(F.count_distinct("h").alias("n_found")).where(F.col("n_found") >= F.lit(contained) * F.col("n_item") - 1e-9)
    return found.join(pairs, ["k1", "k2", "item_id"], "left_semi").select("k1", "k2", "item_id", "n_item", "n_found")


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds an item; all columns, repeated rows, null and empty texts as they are.

    An empty table on either side changes nothing. Columns of any name stay.
    """
    k1, k2 = text_key(docs[text])
    bad = stored(contaminated(docs, items, text, **options).select(F.col("k1").alias("__wl_k1"), F.col("k2").alias("__wl_k2")).distinct(), "bad")
    return docs.join(broadcast_rows(bad, BROADCAST_ROWS), [k1 == bad["__wl_k1"], k2 == bad["__wl_k2"]], "left_anti")
