"""Benchmark decontamination in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (a
shorter item is one shingle of all its words). A window is as many words as the
item has.

1. A window of similarity s or more holds a shingle of any ``n - ceil(s * n) + 1`` of
   an item's n. So documents meet the shingles of each item that are rarest in the
   benchmark, and this aim loses nothing; a shingle that all items share is met
   only where an item has no other. Pairs with fewer shared shingles than the
   similarity needs are left out.
2. Of each aimed document, every item-sized window is taken that holds as many places
   of the item's shingles as the similarity needs, wherever and in whatever order.
3. Each window's SimHash is compared with its item's. A bit is firm if its votes in the
   item are more than a window of that similarity can turn; firm bits must agree, so
   the number of the others is the item's own Hamming radius, and it loses nothing.
   A fixed ``radius`` may be given beside, which can; it is met by multi-index blocks:
   fingerprints within it agree on one of ``radius + 1`` blocks.
4. The remaining windows are verified by the exact weighted Jaccard similarity of
   shingles, a shingle's weight being its count.

At similarity 0.8 few windows are left for the fingerprints to tell apart; the aim and
the places bound the number of windows.

Nulls, empties, repeats: null and empty texts on either side match nothing; a
null doc_id or item_id is kept as such; rows that repeat doc_id and text give
one row for each item, as do benchmark rows that repeat item_id and words; a very long text is searched whole; of windows that tie the
first is given; an empty table gives no rows; other columns, whatever their names,
are ignored (drop_contaminated passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark.llm.common import fits_broadcast, stash, table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: The benchmark's shingles are broadcast up to so many (about 32 bytes each), joined beyond.
BROADCAST_SHINGLES = 500_000
#: Pairs of a document and an item that share a rare shingle are broadcast up to so many, joined beyond.
BROADCAST_PAIRS = 200_000
#: Shingles of broadcast items together (12 bytes each at most).
BROADCAST_CELLS = 4_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of every run of k words; none where there are fewer."""
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))


def _bits(hashes: Column, chosen) -> Column:
    """64 bits, each set where chosen(its votes for 1 less those for 0) holds."""
    votes = lambda b: F.size(F.filter(hashes, lambda x: F.getbit(x, b) == 1)) * 2 - F.size(hashes)
    bit = lambda acc, b: F.when(chosen(votes(b)), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def simhash(hashes: Column) -> Column:
    """64 bits, each set if set in over half of the hashes."""
    return _bits(hashes, lambda votes: votes > 0)


def firm_bits(hashes: Column, similarity: float) -> Column:
    """The SimHash bits that no other hashes of that similarity, of as many or fewer, have otherwise."""
    # hashes of either side without a partner move the votes by one each
    alone = F.floor(F.size(hashes) * (2 * (1 - similarity) / (1 + similarity)) + 1e-6)
    return _bits(hashes, lambda votes: (votes > alone) | (votes <= -alone))


def full_starts(at: Column, need: Column, width: Column, last: Column) -> Column:
    """Starts, up to last, of all runs of width places with need or more of those in at (ascending)."""
    # each start is given with the first place of at that its run holds
    left = lambda i: F.greatest(F.get(at, i + need - 1) - width + 1, F.coalesce(F.get(at, i - 1) + 1, F.lit(0)))
    right = lambda i: F.least(F.get(at, i), last)
    none = F.array().cast("array<int>")
    runs = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.when(left(i) <= right(i), F.sequence(left(i), right(i))).otherwise(none))
    return F.when(F.size(at) >= need, F.flatten(runs)).otherwise(none)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts."""
    count = lambda side, x: F.size(F.filter(side, lambda y: y == x))
    least = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return least / (F.size(a) + F.size(b) - least)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), k, item_sh (shingle hashes), item_fp of items that have words; rows that repeat are one."""
    hashed = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    sized = hashed.select("item_id", F.size("h").alias("size"), F.least(F.size("h"), F.lit(SHINGLE_WORDS)).alias("k"), "h").distinct()
    chosen = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("h"), k)) for k in range(1, SHINGLE_WORDS + 1)])
    return sized.select("item_id", "size", "k", chosen.alias("item_sh")).withColumn("item_fp", simhash(F.col("item_sh")))


def rarest(bench: DataFrame, similarity: float) -> DataFrame:
    """item_id, size, k, off, s: the places of each item's rarest shingles, of which every similar window holds one; bench: see items."""
    known = bench.select("item_id", "size", "k", F.xxhash64("item_sh").alias("own"), F.size("item_sh").alias("n"), F.posexplode("item_sh").alias("off", "s"))
    counts = known.groupBy("k", "s").agg(F.count("*").alias("held"))
    # places of one shingle have one rank, so they are taken together
    rank = F.rank().over(Window.partitionBy("item_id", "size", "own").orderBy("held", "s"))
    enough = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    return known.join(counts, ["k", "s"]).withColumn("rank", rank).where(F.col("rank") <= enough).select("item_id", "size", "k", "off", "s")


def light(df: DataFrame, array: str) -> bool:
    """Whether the arrays of all rows hold BROADCAST_CELLS entries at most."""
    return (df.agg(F.sum(F.size(array))).first()[0] or 0) <= BROADCAST_CELLS


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, hamming: the best window of each such pair.

    A radius leaves out the windows that are more bits than that from their item.
    """
    return best_windows(docs, benchmark, similarity, radius).drop("tx")


def best_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """contaminated(), and tx (a text's hash) beside."""
    least = similarity - 1e-9
    bench = stash(items(benchmark).withColumn("item_firm", firm_bits(F.col("item_sh"), least)), "items")
    sizes = sorted(r["k"] for r in bench.select("k").distinct().collect())  # five values at most
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), word_hashes(F.col("text")).alias("h"))

    known = stash(rarest(bench, similarity), "aimed")
    aimed = F.broadcast(known) if fits_broadcast(known, BROADCAST_SHINGLES) else known
    by_size = [texts.select("doc_id", "tx", F.size("h").alias("n"), F.lit(k).alias("k"), F.posexplode(shingles(F.col("h"), k)).alias("pos", "s")) for k in sizes]
    if not by_size:
        by_size = [texts.select("doc_id", "tx", F.size("h").alias("n"), F.lit(0).alias("k"), F.posexplode(F.col("h")).alias("pos", "s")).where("false")]
    placed = by_size[0]
    for more in by_size[1:]:
        placed = placed.unionByName(more)
    hits = placed.join(aimed, ["k", "s"])
    pairs = stash(hits.select("doc_id", "tx", "item_id", "size", "k").distinct(), "pairs")
    wanted = pairs.select(F.col("doc_id").alias("d"), F.col("tx").alias("t"), "item_id", "size", "k")
    wanted = F.broadcast(wanted) if fits_broadcast(pairs, BROADCAST_PAIRS) else wanted
    own = bench.select(F.col("item_id").alias("i"), F.col("size").alias("i_size"), "item_sh", "item_fp", "item_firm")
    own = F.broadcast(own) if fits_broadcast(bench, BROADCAST_SHINGLES // 50) and light(bench, "item_sh") else own
    raw = docs.select(F.col("doc_id").cast("long"), "text")
    met = raw.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))).select("doc_id", "t", "item_id", "size", "k", word_hashes(F.col("text")).alias("h"))
    whole = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("h"), k)) for k in sizes or [1]])
    met = met.select("doc_id", "t", "item_id", "size", "k", F.size("h").alias("n"), whole.alias("all"))
    met = stash(met, "met").join(own, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("i_size")))
    # places of the item whose shingle the document has, at most
    places = F.size(F.array_intersect("item_sh", "all")) + F.size("item_sh") - F.size(F.array_distinct("item_sh"))
    met = met.where(places >= F.size("item_sh") * least)
    width = F.least("n", "size") - F.col("k") + 1
    need = F.greatest(F.ceil((F.size("item_sh") + width) * (least / (1 + least)) - 1e-9), F.lit(1)).cast("int")
    held = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.array_contains("item_sh", F.get("all", i)))
    met = met.select("doc_id", "t", "item_id", "size", "n", "all", width.alias("width"), need.alias("need"), F.greatest(F.col("n") - F.col("size"), F.lit(0)).alias("last"), held.alias("at"))
    starts = full_starts(F.col("at"), F.col("need"), F.col("width"), F.col("last"))
    windows = met.select("doc_id", "t", "item_id", "size", "n", "all", "width", F.explode(starts).alias("start"))
    chosen = F.slice("all", F.col("start") + 1, F.col("width"))
    # written, so that no filter is pushed into the lambdas that make the windows
    windows = stash(windows.select("doc_id", "t", "item_id", "size", "start", F.least("n", "size").alias("n_words"), chosen.alias("sh")), "windows")
    windows = windows.where(F.size("sh") > 0).withColumn("fp", F.coalesce(simhash(F.col("sh")), F.lit(0).cast("long")))

    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    agrees = apart.bitwiseAND(F.col("item_firm")) == 0
    if radius is not None:
        shared = F.lit(False)
        for mask in _masks(radius + 1):
            shared = shared | (apart.bitwiseAND(F.lit(mask)) == 0)
        agrees = agrees & shared & (F.bit_count(apart) <= radius)
    found = (
        windows.join(own, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("i_size")))
        .where(agrees).withColumn("hamming", F.bit_count(apart))
        .withColumn("similarity", weighted_jaccard(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= least)
    )
    best = F.max_by(F.struct("start", "n_words", "similarity", "hamming"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "t", "item_id").agg(best.alias("b")).select("doc_id", F.col("t").alias("tx"), "item_id", F.col("b.start").alias("start_word"), "b.n_words", "b.similarity", "b.hamming")


def _masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The rows of docs that hold no benchmark item; their columns as they are."""
    gone = stash(best_windows(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("tx").alias("_tx")).distinct(), "leaks")
    side = F.broadcast(gone) if fits_broadcast(gone, broadcast_ids) else gone
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_doc"]) & (F.xxhash64(docs["text"]) == side["_tx"]), "left_anti")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
