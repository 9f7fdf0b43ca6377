"""Operator 3: mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import finished, keyed, materialise, scratch, words

#: Tokens of a block: what a slot of the schedule takes of its source.
BLOCK = 1024
#: Documents of a hash bucket, about: prefix sums go over buckets first, then within each.
DOCS_A_BUCKET = 20_000
#: Documents of a part of the mix, about.
DOCS_A_PART = 8192
#: Slots of a chunk: ranks go over chunks first, then within each.
SLOTS_A_CHUNK = 1 << 16
GOLDEN = 0.6180339887498949
CELLS = 1 << 12
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: id in code point order (null last), weight, size, target and whole-token quota.

    Weights run 1, 2, 3, 1, ...  Together the targets are all tokens.  A target stops at
    ``max_repeats`` times its source; what is over goes to the others by weight until none
    is above.  In the order of cap by weight the capped sources come first, so one pass of
    running sums finds the level at which resharing ends.  Only rows per source meet here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))).cast("int"))
    weighed = numbered.select("source", "src", "source_size", ((F.col("src") - 1) % 3 + 1).alias("weight"), (F.col("source_size") * max_repeats).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "src")
    everything = Window.partitionBy()
    run = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - (F.sum("most").over(order) - F.col("most"))).alias("left_tokens"),
        (F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight"))).alias("left_weight"),
    )
    capped = F.col("most") / F.col("weight") < F.col("left_tokens") / F.col("left_weight")
    run = run.withColumn("capped", capped)
    # every uncapped source shares the level that holds at the first of them
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("src"), (F.col("left_tokens") / F.col("left_weight")).alias("level")))).over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * level["level"])
    run = run.withColumn("target", F.least(target, F.col("most").cast("double")))
    return run.select("source", "src", "weight", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("most")).cast("long").alias("quota"))


def _shuffle_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def shuffled_stream(rows: DataFrame, seed: str) -> DataFrame:
    """Add ``start``: the tokens ahead of each document in its source's shuffled order.

    The order is by the md5 of seed and id.  Sums go over (source, hash prefix) first and
    within a prefix after, so a source with a third of all documents is dealt to many tasks.
    """
    n = rows.count()
    digits = max(0, math.ceil(math.log(max(1, n / DOCS_A_BUCKET), 16)))
    hashed = rows.withColumn("__h", _shuffle_key(seed))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, digits))
    buckets = hashed.groupBy("src", "__b").agg(F.sum("size").alias("s"))
    ahead = buckets.select("src", "__b", (F.sum("s").over(Window.partitionBy("src").orderBy("__b")) - F.col("s")).alias("__ahead"))
    inner = Window.partitionBy("src", "__b").orderBy("__h", "doc_id", "size", "rid")
    joined = hashed.join(ahead, ["src", "__b"])
    return joined.withColumn("start", F.col("__ahead") + F.sum("size").over(inner) - F.col("size")).drop("__h", "__b", "__ahead")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The slots of the mix: slot, src, rank, epoch, blk and the tokens that the slot takes of its block.

    Point ``n`` of the golden-ratio sequence falls into the cumulative shares of the
    sources' slot counts; the k-th point of a source is its slot of rank k.  Ranks beyond a
    source's count are left out and ranks that the points miss (a few for each source, as
    the sequence's discrepancy is logarithmic) follow at the end, so each source takes its
    quota to the token.  Ranks are counted by chunk of slots first, then within the chunk.
    """
    spark = targets.sparkSession
    full = F.expr(f"(source_size + {block - 1}L) div {block}L")
    rest = F.when(F.col("source_size") > 0, F.col("quota") % F.col("source_size")).otherwise(F.lit(0))
    per = targets.where("source_size > 0 and quota > 0").select(
        "src", "source_size", full.alias("nb"), rest.alias("rest"), (F.expr("quota div source_size") * full + F.ceil(rest / block)).cast("long").alias("slots"), F.expr("quota div source_size").alias("epochs")
    )
    total = int(per.agg(F.sum("slots")).first()[0] or 0)
    bounds = per.withColumn("hi", F.sum("slots").over(Window.orderBy("src")) / F.lit(max(1, total))).withColumn("lo", F.col("hi") - F.col("slots") / F.lit(max(1, total)))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS).cast("long")))))
    points = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % 1.0).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS)).withColumn("chunk", F.expr(f"slot div {SLOTS_A_CHUNK}L"))
    hit = points.join(bounds, (points["cell"] == bounds["cell"]) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "chunk", "src")
    counts = hit.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("ahead"))
    ranked = hit.join(ahead, ["src", "chunk"]).select("src", "slot", (F.col("ahead") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).alias("rank"))
    drawn = counts.groupBy("src").agg(F.sum("n").alias("drawn"))
    late = per.join(drawn, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    late = late.where("drawn < slots").select("src", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("rank"))
    late = late.select("src", (F.lit(total) + F.col("rank") * F.lit(1 << 20) + F.col("src")).alias("slot"), "rank")
    slots = ranked.unionByName(late).join(per, "src").where("rank < slots")
    slots = slots.select("slot", "src", "rank", F.expr("rank div nb").alias("epoch"), F.expr("rank % nb").alias("blk"), "epochs", "rest")
    upto = F.when(F.col("epoch") < F.col("epochs"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("blk") * block))
    return slots.select("slot", "src", "rank", "epoch", "blk", upto.cast("long").alias("upto"))


def mix(sizes: DataFrame, seed: str = "mix", max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix documents (rid, doc_id, source, size) to their sources' targets.

    Returns the rows with ``src`` and ``start``, the targets, and the mix itself: one row per
    (slot, document) with the tokens ``first`` to ``first + tokens`` of the document that the
    slot takes.  Sizes of 0 and empty tables take nothing.
    """
    block = BLOCK
    targets = materialise(source_targets(sizes, max_repeats), "mix_targets")
    rows = sizes.join(targets.select("source", "src"), sizes["source"].eqNullSafe(targets["source"])).select("rid", "doc_id", "src", "size")
    stream = materialise(shuffled_stream(rows, seed), "mix_stream")
    last = F.col("start") + F.col("size") - 1
    pieces = stream.where("size > 0").withColumn("blk", F.explode(F.sequence(F.expr(f"start div {block}L"), F.expr(f"(start + size - 1) div {block}L"))))
    pieces = pieces.select("rid", "src", "blk", "start", F.greatest(F.col("start"), F.col("blk") * block).alias("lo"), F.least(last + 1, (F.col("blk") + 1) * block).alias("hi"))
    taken = schedule(targets, block).join(pieces, ["src", "blk"])
    end = F.least(F.col("hi"), F.col("blk") * block + F.col("upto"))
    taken = taken.withColumn("tokens", end - F.col("lo")).where("tokens > 0")
    return stream, targets, taken.select("slot", "src", "rank", "epoch", "blk", "rid", (F.col("lo") - F.col("start")).alias("first"), "tokens")


def document_sizes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source and the words of the whole text, written once so that rids stay the same."""
    size = F.size(words(F.col("text"))).cast("long")
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size")), "mix_sizes")


@finished("mix")
def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: size, its source's size and target, the words that the mix takes, repeats counted, and the first
    slot of the schedule that takes some of them (null if none does)."""
    sizes = document_sizes(docs)
    stream, targets, taken = mix(sizes, seed)
    sums = taken.groupBy("rid").agg(F.sum("tokens").alias("taken"), F.min("slot").alias("slot"))
    out = stream.join(sums, "rid", "left").join(targets.select("src", "source_size", "target"), "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as documents in the schedule's order: each one as often as it is taken, a last copy cut to the words taken.

    Documents of which nothing is taken go.  All columns are kept; ``n_chars`` follows a cut.
    A copy stands where the first slot stands that takes of it, so any stretch of the result
    has about the sources' target shares.
    """
    named = keyed(docs)
    with scratch(docs.sparkSession):
        sizes = materialise(named.select(F.col("__tf_key").alias("rid"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix_sizes")
        _, _, taken = mix(sizes, seed)
        copies = taken.groupBy("rid", "epoch").agg(F.min("slot").alias("__tf_slot"), F.sum("tokens").alias("__tf_tokens"))
        copies = materialise(copies.join(sizes.select("rid", "size"), "rid").select(F.col("rid").alias("__tf_key"), "__tf_slot", "__tf_tokens", (F.col("__tf_tokens") < F.col("size")).alias("__tf_part")), "mix_copies", keep=True)
    n, last = copies.agg(F.count(F.lit(1)), F.max("__tf_slot")).first()
    parts = max(1, -(-n // DOCS_A_PART))
    # slots are about evenly taken, so equal ranges of them are equal parts
    part = F.least(F.lit(parts - 1), F.floor(F.col("__tf_slot") * parts / F.lit((last or 0) + 1))).cast("int")
    joined = named.join(copies, "__tf_key").repartitionById(parts, part).sortWithinPartitions("__tf_slot", "__tf_key")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    shorter = F.array_join(F.slice(pieces, F.lit(1), F.col("__tf_tokens").cast("int")), "")
    out = joined.withColumn("text", F.when(F.col("__tf_part"), shorter).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tf_part"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
