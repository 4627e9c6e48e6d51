"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, its documents in a pseudorandom order, are packed into blocks of
BLOCK_WORDS. The mix is a sequence of slots, each for one block, cut into output shards. How many
slots of a shard each source gets is drawn: a pseudorandom permutation deals all slots of all sources
to the places of the mix, so a shard's counts are multinomial draws given the sources' totals (free
draws would miss the targets and the bound of two times). A shard's slots of a source are numbered on
from those of the shards before it; a number is mapped through a pseudorandom permutation of the
source's block indexes, another one for each pass over them, and blocks are joined by source and index. Both
permutations are swap-or-not shuffles, computed from a number alone; nothing is sorted or collected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import written

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
ROUNDS = 24
SLOT_CHUNK = 1 << 14
#: Shards whose counts are summed at once when slots are numbered.
SHARD_GROUP = 1024
#: Documents of all sources that are dealt to one hash range before each source's words are numbered there.
RANGE_DOCS = 2000
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, so that pieces keep a text's own spacing.
SPACED = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


def _swap_or_not(x: Column, n: Column, seed: Column, rounds: Column) -> Column:
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(x, other)), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(rounds, x.cast("long"), swap)


def shuffled(x: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 applied to x: rounds of a swap-or-not shuffle."""
    return _swap_or_not(x, n, seed, F.sequence(F.lit(1), F.lit(ROUNDS)))


def unshuffled(x: Column, n: Column, seed: Column) -> Column:
    """The inverse of shuffled(): each round undoes itself, so they run backwards."""
    return _swap_or_not(x, n, seed, F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """key, source, source_size -> with target: weights by code point order (null last), capped and reshared.

    Capped water-filling in closed form: with the sources sorted by size / weight, those up to a
    point are full (`most` times their size) and the rest share what is left by weight. A window over
    one row per source; sources are the only thing that stands in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    cap = most * F.col("source_size")
    by = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    placed = weighed.select(
        "*",
        cap.alias("cap"),
        (share * F.sum("source_size").over(every)).alias("total"),
        F.coalesce(F.sum(cap).over(upto), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("open_weight"),
    )
    level = F.try_divide(F.col("total") - F.col("full"), F.col("open_weight"))
    # the level at which the first source in this order isn't full holds for it and all after it
    leveled = placed.withColumn("level", level).withColumn("full_here", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full_here"), F.col("level"))).over(every)
    target = F.when(F.col("full_here"), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return leveled.select("key", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size: its number of words; null texts have 0."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each of sized (key, doc_id, hash, size) with copy, first (the number of its first word in its source), and its source's columns.

    Rows go in the order of a hash. Rows equal in all are one row with a count while words are summed,
    and copies from 0 after it. Words are summed per hash range first, so that no source's rows
    meet in one task; ranges are numbered per source by a window over their sums only.
    """
    n = max(1, -(-sized.count() // RANGE_DOCS))
    counted = sized.groupBy("key", "doc_id", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    keyed = counted.withColumn("range", F.pmod(F.xxhash64("hash", F.lit(7)), F.lit(n))).withColumn("words", F.col("size") * F.col("copies"))
    by = Window.partitionBy("key").orderBy("range")
    sums = keyed.groupBy("key", "range").agg(F.sum("words").alias("words"))
    begun = sums.withColumn("begin", F.sum("words").over(by) - F.col("words")).drop("words").join(sources.drop("source"), "key")
    inside = Window.partitionBy("key", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = keyed.withColumn("inside", F.sum("words").over(inside) - F.col("words")).drop("words")
    placed = own.join(begun, ["key", "range"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.withColumn("first", F.col("begin") + F.col("inside") + F.col("copy") * F.col("size")).drop("range", "begin", "inside", "copies")


def block_counts(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sources with blocks, slots (how many slots of the mix take its blocks), begin (of its slots), total."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    mean = F.try_divide(F.col("source_size").cast("double"), F.col("blocks"))
    slots = F.coalesce(F.least(F.round(F.try_divide(F.col("target"), mean)).cast("long"), 2 * F.col("blocks")), F.lit(0).cast("long"))
    made = sources.withColumn("blocks", blocks).withColumn("slots", slots)
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("begin", F.coalesce(F.sum("slots").over(before), F.lit(0).cast("long"))).withColumn("total", F.sum("slots").over(Window.partitionBy()))


def shard_counts(counted: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """key, shard, n: how many slots of a shard were drawn for a source; none where it got none.

    Each source's slots are dealt in chunks, so that a source with most of them is not one task.
    """
    chunks = counted.filter("slots > 0").select("key", "slots", "begin", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK).cast("long"))).alias("chunk"))
    low = F.col("chunk") * SLOT_CHUNK
    made = _dealt(chunks, "chunk").select("key", "begin", "total", F.explode(F.sequence(low, F.least(low + SLOT_CHUNK, F.col("slots")) - 1)).alias("within"))
    slot = unshuffled(F.col("begin") + F.col("within"), F.col("total"), F.lit(seed))
    return made.select("key", F.floor(slot / shard_slots).cast("long").alias("shard")).groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Few rows that many come of: dealt to a number of partitions that isn't coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", by)


def slots(drawn: DataFrame, counted: DataFrame, seed: int) -> DataFrame:
    """key, shard, pass, index (of a block): one row per slot of the mix, from the (written) counts that shards have drawn.

    A source's slots are numbered through its shards: counts are summed per group of shards, then
    within each, so that no source's shards meet in one task.
    """
    grouped = drawn.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    by, inside = Window.partitionBy("key").orderBy("group"), Window.partitionBy("key", "group").orderBy("shard")
    sums = grouped.groupBy("key", "group").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(by) - F.col("m")).drop("m")
    begun = grouped.withColumn("begun", F.sum("n").over(inside) - F.col("n")).join(sums, ["key", "group"])
    told = begun.select("key", "shard", "n", (F.col("before") + F.col("begun")).alias("low")).join(counted.select("key", "blocks"), "key")
    made = _dealt(told, "shard").select("key", "shard", "blocks", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("number"))
    turn = F.floor(F.col("number") / F.col("blocks")).cast("long")
    index = shuffled(F.pmod("number", "blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "key", turn))
    # never null, and seen to be: a filter for that under a join would work the permutation twice
    return made.select("key", "shard", turn.alias("pass"), F.coalesce(index, F.lit(0).cast("long")).alias("index"))


def mix(docs: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, counts, pieces) of a mix of docs' doc_id, text and source.

    documents: doc_id, hash (of the text), copy (of rows equal in both), key (of the source), size,
    source_size, target, first. counts: the draws, as shard_counts(). pieces: a row per document and
    block of it: the columns of documents, from, to (words of the document, to excluded), index,
    slots (<pass, shard> of each slot of the mix that takes the block, else null). Null ids, sources and texts are values of their own, repeated
    rows count each, other columns are left out, and empty tables give none.
    """
    named = docs.select("doc_id", F.col("text"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"))
    sized = written(measured(named).select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), "key", "source", "size"), "sizes")
    sources = targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    sources = written(block_counts(sources, block_words), "sources")
    documents = packed(sized.drop("source"), sources.select("key", "source", "source_size", "target"))
    drawn = written(shard_counts(sources, seed), "draws")
    times = slots(drawn, sources, seed).groupBy("key", "index").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("slots"))
    low, high = F.floor(F.col("first") / block_words), F.floor((F.col("first") + F.col("size") - 1) / block_words)
    spans = documents.filter("size > 0").withColumn("index", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("first"), F.col("index") * block_words) - F.col("first")
    end = F.least(F.col("first") + F.col("size"), (F.col("index") + 1) * block_words) - F.col("first")
    pieces = spans.withColumn("from", begin).withColumn("to", end).join(times.hint("merge"), ["key", "index"], "left")
    return documents, drawn, pieces


def taken_words(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of each document's words the mix takes."""
    documents, _, pieces = mix(docs, seed)
    words = (F.col("to") - F.col("from")) * F.coalesce(F.size("slots"), F.lit(0))
    taken = pieces.groupBy("doc_id", "key", "first", "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(columns).unionByName(documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed_texts(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with text and n_chars of the words that the mix takes of each, with their own spacing.

    Pieces of the first pass come first, in the document's order, then, on a new line where they
    begin with its first word, those of the second. A
    document without words stays as it is; one of which no word is taken goes. Columns stay.
    """
    _, _, pieces = mix(docs, seed)
    one = F.explode("slots.pass").alias("pass")
    lists = pieces.select("doc_id", "hash", "copy", "from", "to", one).groupBy("doc_id", "hash", "copy").agg(F.sort_array(F.collect_list(F.struct("pass", "from", "to"))).alias("__cuts"))
    renamed = lists.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__h"), F.col("copy").alias("__c"), "__cuts")
    hashed = docs.withColumn("__hash", F.xxhash64("doc_id", "text"))
    numbered = hashed.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("__hash")) - 1)
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")) & (F.col("__copy") == F.col("__c"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACED), F.lit(0))

    def joined_cuts(words: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            own = F.array_join(F.slice(words, (c["from"] + 1).cast("int"), (c["to"] - c["from"]).cast("int")), "")
            return F.concat(F.when((i > 0) & (c["from"] == 0), F.lit("\n")).otherwise(F.lit("")), own)

        return F.array_join(F.transform("__cuts", piece), "")

    cut = F.get(F.transform(F.array(words), joined_cuts), F.lit(0))  # the words are found once a row
    kept = numbered.join(renamed.hint("merge"), on, "left").filter(F.col("__cuts").isNotNull() | (F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(cut)
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
