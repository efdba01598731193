"""Benchmark decontamination by a broadcast hash table of test n-grams.

Texts are normalised alike: A-Z lower-cased, words are runs of digits, letters
a-z and non-ASCII characters. The items' windows of ``n`` words (an item with
fewer, but not none, is one window) are the table, keyed by a 64-bit hash. Every
document's windows are scanned against it in one generated loop; a hash hit
counts only if the words themselves agree (a second hash of them, if the table is
too large to broadcast). Words inside a found window are hit;
documents lose those spans or are dropped.

The table is broadcast while it holds at most ``BROADCAST_BYTES``; a larger one
is joined by shuffling the windows on their hash, where adaptive execution
splits hot hashes. Documents are never moved for the scan itself.

Defined results: a null text or item has no words; a null ``item_id`` still hits
but is not listed; repeated items count once; repeated rows and null ids are
judged row by row; extra columns pass through; with an empty benchmark nothing
is hit; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentier.llm.shared import free_names

WINDOW = 10
BROADCAST_BYTES = 64 << 20
_SIGN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what stands between words, in any case
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() alone would also change letters beyond ASCII
    ascii_only = F.octet_length(t) == F.length(t)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, upper, lower)), _OTHER), "")


def _window_hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(n)])


def ngrams(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(key, size, gram, items): the distinct windows of all items."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.size("w"), F.lit(n)))
    at = w.select("item", "w", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    grams = at.select("item", "size", F.slice("w", F.col("at") + 1, F.col("size")).alias("g"))
    key = F.lit(None).cast("long")
    for k in range(1, n + 1):
        key = F.when(F.col("size") == k, _window_hash(F.col("g"), F.lit(0), k)).otherwise(key)
    return (grams.select("item", "size", F.concat_ws(" ", "g").alias("gram"), key.alias("key"))
            .groupBy("key", "size", "gram").agg(F.collect_set("item").alias("items")))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, spans array<struct<start, size>>
    (found windows, left to right) and items (their ids, sorted)."""
    grams = ngrams(benchmark, n)
    known = grams.agg(F.collect_set("size"), F.sum(F.octet_length("gram") + 64 + 16 * F.size("items"))).first()
    sizes, weight = sorted(known[0] or []), known[1] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("w"))
    # one row per window start; the first row of a document also stands for itself
    n_words = F.size("w")
    least = sizes[0] if sizes else n
    starts = rows.select("row", "doc_id", "w", n_words.alias("n_words"),
                         F.explode(F.sequence(F.lit(0), F.greatest(n_words - least, F.lit(0)))).alias("at"))
    if not sizes:
        found = starts.where("at = 0").select("row", "doc_id", "n_words", F.lit(None).cast("struct<start:int,size:int>").alias("span"),
                                              F.lit(None).cast("array<string>").alias("items"))
    else:
        if len(sizes) == 1:
            tries = starts.withColumn("size", F.lit(sizes[0])).withColumn(
                "key", F.when(F.col("at") + sizes[0] <= F.col("n_words"), _window_hash(F.col("w"), F.col("at"), sizes[0])))
        else:
            hashes = F.array(*[F.struct(F.lit(k).alias("size"), F.when(F.col("at") + k <= F.col("n_words"),
                                        _window_hash(F.col("w"), F.col("at"), k)).alias("key")) for k in sizes])
            tries = (starts.withColumn("t", F.explode(hashes))
                     .select("row", "doc_id", "w", "n_words", "at", "t.size", "t.key"))
        # a start without a whole window gets a key of its own: no hot null
        tries = tries.withColumn("key", F.coalesce("key", F.xxhash64("row", "at")))
        table = grams.withColumnRenamed("size", "gram_size")
        own = F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("size")))
        if weight <= BROADCAST_BYTES:
            # the window's words are put together for hash hits only
            joined, verified = tries.join(F.broadcast(table), "key", "left"), own == F.col("gram")
        else:
            # only hashes are shuffled: a second one, of the joined words, verifies
            tries = tries.withColumn("check", F.xxhash64(F.lit(1), own)).drop("w")
            table = table.withColumn("gram_check", F.xxhash64(F.lit(1), F.col("gram")))
            joined, verified = tries.join(table, "key", "left"), F.col("check") == F.col("gram_check")
        same = F.coalesce((F.col("gram_size") == F.col("size")) & (F.col("at") + F.col("size") <= F.col("n_words"))
                          & verified, F.lit(False))
        found = (joined.withColumn("hit", F.when(F.col("gram").isNotNull(), same).otherwise(F.lit(False)))
                 .where(F.col("hit") | (F.col("at") == 0))
                 .select("row", "doc_id", "n_words",
                         F.when(F.col("hit"), F.struct(F.col("at").alias("start"), F.col("size"))).alias("span"),
                         F.when(F.col("hit"), F.col("items")).alias("items")))
    return (found.groupBy("row", "doc_id", "n_words")
            .agg(F.sort_array(F.collect_set("span")).alias("spans"),
                 F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", "items"))


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["start"] + s["size"]).alias("upto"),
            (acc["n"] + F.greatest(s["start"] + s["size"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n")))
    return step["n"]


def report(scanned: DataFrame) -> DataFrame:
    """The registered digest of a scan."""
    hit = covered(F.col("spans"))
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                          (hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which any window was found. A row is
    known by its id and text, so equal rows share their verdict."""
    tag, = free_names(docs, "_tag")
    marked = docs.withColumn(tag, _row_tag())
    bad = (scan(marked.select(F.col(tag).alias("doc_id"), "text"), benchmark, n)
           .where(F.size("spans") > 0).select(F.col("doc_id").alias(tag)).distinct())
    return marked.join(bad, tag, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _row_tag() -> Column:
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")),
                       F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def clean_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with the words inside found windows, and the signs before each of
    them, cut out of the text; what is left stands as it was."""
    tag, found = free_names(docs, "_tag", "_spans")
    marked = docs.withColumn(tag, _row_tag())
    spans = (scan(marked.select(F.col(tag).alias("doc_id"), "text"), benchmark, n).where(F.size("spans") > 0)
             .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias(tag), F.col("spans").alias(found)))
    text = F.col("text").cast("string")
    pieces = F.regexp_extract_all(text, F.lit(f"[{_SIGN}]*[^{_SIGN}]+"), F.lit(0))  # a word with the signs before it
    inside = lambda w, i: F.exists(found, lambda s: (s["start"] <= i) & (i < s["start"] + s["size"]))
    left = F.concat(F.array_join(F.filter(pieces, lambda w, i: ~inside(w, i)), ""), F.regexp_extract(text, rf"[{_SIGN}]*\z", 0))
    out = marked.join(spans, tag, "left").withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(left))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
