"""Operator 1: benchmark decontamination with a positional inverted index (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import finished, keyed, lower_ascii, materialise, scratch, tested, without, words

#: What separates words: ASCII but digits and (lower-case) letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: Words that a near match may have between the window's.
SLOP = 2
#: Terms are broadcast up to this many rows and bytes; beyond, they are joined by a shuffle on the term.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index: (term, rid, pos, doc_id), a row for each place of a term.  Written once.

    It is split by documents: each task sorts the postings of its documents by term, document
    and position, so a term's list is a run in each file, no list is ever gathered whole, and
    nothing is shuffled.  The empty term, which no word is, has one posting for each document:
    its position is the number of words, and it alone carries the document's id.
    """
    split = words(lower_ascii(F.col(text_col)), SEPARATORS)
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), split.alias("words"))
    placed = named.select("rid", "doc_id", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "term"))
    rows = placed.select("term", "rid", "pos", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"))
    return materialise(rows.sortWithinPartitions("term", "rid", "pos"), "postings", **{"parquet.writer.version": "PARQUET_2_0"})


def lengths(index: DataFrame) -> DataFrame:
    """rid, doc_id and n_words of each document of the index."""
    return index.where(F.col("term") == "").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (wid, window) of ``size`` consecutive item words with the items that hold them.  Written once.

    An item of fewer words, but not none, is one window.  A null item id is kept as such.
    """
    split = items.select("item_id", words(lower_ascii(F.col("text")), SEPARATORS).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    cut = materialise(split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window")).distinct(), "windows")
    named = materialise(cut.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "window_ids")
    return cut.join(named, "window")


def small(df: DataFrame, text_bytes: str) -> bool:
    """Whether a table is under the broadcast bound, by its counted rows and bytes."""
    n, b = df.agg(F.count(F.lit(1)), F.sum(F.expr(text_bytes))).first()
    return n <= BROADCAST_ROWS and (b or 0) <= BROADCAST_BYTES


def _shared(df: DataFrame, text_bytes: str = "octet_length(term)") -> DataFrame:
    """The table as a broadcast side if it is small, else as it is."""
    return F.broadcast(df) if small(df, text_bytes) else df


def ranked_terms(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(wid, len, t): each window's terms from the rarest to the most frequent, as (df, off, term).

    Windows with a term that the index lacks can't occur and are left out.
    """
    placed = wins.select("wid", "window").distinct().select("wid", F.size("window").alias("len"), F.posexplode("window").alias("off", "term"))
    terms = _shared(placed.select("term").distinct())
    counts = materialise(index.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term_counts")
    listed = placed.join(counts, "term").groupBy("wid", "len").agg(F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("t"))
    return materialise(listed.where(F.size("t") == F.col("len")), "ranked_terms")


def lists(index: DataFrame, ranked: DataFrame, rank: int) -> DataFrame:
    """The postings of each window's term of this rank, moved back by its offset: (rid, start, wid)."""
    at = F.get("t", F.lit(rank))
    terms = ranked.where(F.size("t") > rank).select("wid", at["term"].alias("term"), at["off"].alias("off"))
    moved = index.join(_shared(terms), "term").select("rid", (F.col("pos") - F.col("off")).alias("start"), "wid")
    return moved.where("start >= 0")


def intersection(candidates: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """The candidates that are also in the other list.  Of the others only those that may be candidates are moved."""
    name = F.xxhash64(*on)
    kept = tested(others.select(*on).withColumn("__tf_h", name), candidates.select(name.alias("__tf_h")), "__tf_h").where("__tf_maybe").select(*on)
    return candidates.join(kept.hint("merge"), on, "left_semi")


def occurrences(index: DataFrame, wins: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Where windows occur word for word: rid, start (from 0), len, wid.

    The postings of each window's rarest term, moved back by its offset, are the candidate
    starts; they are intersected with the moved postings of the next rarest term.  What is
    left looks up all other terms at their places at once, and stays if each is there.
    """
    ranked = ranked_terms(index, wins) if ranked is None else ranked
    first = materialise(lists(index, ranked, 0), "first_lists")
    both = materialise(intersection(first.join(_shared(ranked.where("len > 1").select("wid"), "8"), "wid", "left_semi"), lists(index, ranked, 1), ["rid", "start", "wid"]), "second_lists")
    rest = F.slice("t", 3, F.greatest(F.lit(1), F.col("len") - 2))
    needed = _shared(ranked.where("len > 2").select("wid", "len", rest.alias("rest")), "octet_length(array_join(rest.term, ' '))")
    probes = both.join(needed, "wid").select("rid", "start", "wid", "len", F.explode("rest").alias("r"))
    probes = materialise(probes.select("rid", "start", "wid", "len", (F.col("start") + F.col("r.off")).alias("pos"), F.col("r.term").alias("term")), "probes")
    there = intersection(probes, index.where(F.col("term") != ""), ["rid", "pos", "term"])
    whole = there.groupBy("rid", "start", "wid", "len").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("len") - 2)
    single = first.join(_shared(ranked.where("len = 1").select("wid"), "8"), "wid", "left_semi")
    double = both.join(_shared(ranked.where("len = 2").select("wid"), "8"), "wid", "left_semi")
    columns = ["rid", "start", "len", "wid"]
    short = single.withColumn("len", F.lit(1)).select(*columns).unionByName(double.withColumn("len", F.lit(2)).select(*columns))
    return whole.select(*columns).unionByName(short)


def proximity(index: DataFrame, wins: DataFrame, slop: int, ranked: DataFrame | None = None) -> DataFrame:
    """The (rid, wid) where some run of ``slop`` words more than the window holds all terms of the window, in any order.

    Windows with the same two rarest terms share their candidates: the rarest's postings that
    have one of the next rarest within reach.  Only these look for the windows' other terms,
    in the cells of the document where they may be, so no list is repeated for each window of its term.
    """
    ranked = ranked_terms(index, wins) if ranked is None else ranked
    distinct = F.array_distinct(F.transform("t", lambda x: x["term"]))
    listed = ranked.select("wid", (F.col("len") + slop).alias("reach"), distinct.alias("terms"))
    named = materialise(listed.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "term_ids")
    numbered = listed.select("wid", "reach", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term")).join(named, "term")
    numbered = numbered.groupBy("wid", "reach", "n").agg(F.sort_array(F.collect_list(F.struct("k", "tid"))).alias("t"))
    numbered = materialise(numbered.select("wid", "reach", "n", F.get("t", F.lit(0))["tid"].alias("first"), F.get("t", F.lit(1))["tid"].alias("second"), F.slice("t", 2, F.greatest(F.lit(1), F.col("n") - 1)).alias("others")), "window_terms")
    width = 2 * (numbered.agg(F.max("reach")).first()[0] or 1)  # so that what is in reach is in two cells at most
    pair = ["reach", "first", "second"]

    def placed(tids: DataFrame) -> DataFrame:
        return index.join(_shared(named.join(tids.distinct(), "tid")), "term").select("rid", "tid", "pos", F.expr(f"pos div {width}").alias("cell"))

    def cells() -> Column:
        return F.explode(F.sequence(F.expr(f"greatest(0, at - reach + 1) div {width}"), F.expr(f"(at + reach - 1) div {width}")))

    def found(probes: DataFrame, tids: DataFrame) -> DataFrame:
        on = ["rid", "tid", "cell"]
        near = tested(placed(tids).withColumn("__tf_h", F.xxhash64(*on)), probes.select(F.xxhash64(*on).alias("__tf_h")), "__tf_h")
        return near.where("__tf_maybe").select(*on, "pos")

    first = placed(numbered.select(F.col("first").alias("tid"))).select("rid", F.col("tid").alias("first"), F.col("pos").alias("at"))
    pairs = numbered.where("n > 1").select(*pair).distinct()
    anchors = materialise(first.join(_shared(pairs, "8"), "first").select("rid", *pair, "at"), "anchors")
    spread = anchors.select("rid", *pair, "at", F.col("second").alias("tid"), cells().alias("cell"))
    seconds = found(spread, pairs.select(F.col("second").alias("tid"))).hint("merge")
    close = spread.join(seconds, (spread["rid"] == seconds["rid"]) & (spread["tid"] == seconds["tid"]) & (spread["cell"] == seconds["cell"]) & (F.abs(seconds["pos"] - spread["at"]) < spread["reach"]), "left_semi")
    close = close.select("rid", *pair, "at").distinct()
    candidates = materialise(close.join(_shared(numbered.where("n > 1"), "8 * n"), pair).select("rid", "wid", "at", "reach", "n", "others"), "candidates")
    probes = candidates.select("rid", "wid", "at", "reach", "n", "others", cells().alias("cell")).select("rid", "wid", "at", "reach", "n", "cell", F.inline("others"))
    others = found(probes, numbered.where("n > 1").select(F.explode("others.tid").alias("tid")))
    near = probes.join(others.hint("merge"), ["rid", "tid", "cell"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    held = near.groupBy("rid", "wid", "at", "reach", "n").agg(F.collect_list(F.struct("k", "pos")).alias("held"))  # of 2 * reach words at most
    begins = F.sequence(F.col("at") - F.col("reach") + 1, F.col("at"))

    def full(begin: Column) -> Column:
        inside = F.filter("held", lambda h: (h["pos"] >= begin) & (h["pos"] < begin + F.col("reach")))
        return F.size(F.array_distinct(F.transform(inside, lambda h: h["k"]))) == F.col("n") - 1

    several = held.where(F.exists(begins, full)).select("rid", "wid")
    single = first.join(_shared(numbered.where("n = 1").select("wid", "first"), "8"), "first").select("rid", "wid")
    return several.unionByName(single).distinct()


@finished("matches")
def matches(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per document and window that it holds, exactly or nearly: doc_id, window (its words), n_exact and near."""
    index = postings(docs)
    wins = materialise(windows(items), "item_windows")
    ranked = ranked_terms(index, wins)
    exact = occurrences(index, wins, ranked).groupBy("rid", "wid").agg(F.count(F.lit(1)).alias("n_exact"))
    near = proximity(index, wins, slop, ranked).withColumn("near", F.lit(True))
    both = near.join(exact, ["rid", "wid"], "left").join(lengths(index).select("rid", "doc_id"), "rid")
    text = wins.select("wid", F.array_join("window", " ").alias("window")).distinct()
    return both.join(text, "wid").select("doc_id", "window", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"), "near")


def contamination(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index, and per text with hits: rid, n_hit (words inside any occurrence) and the distinct items' count and hash."""
    index = postings(docs)
    wins = materialise(windows(items), "item_windows")
    found = materialise(occurrences(index, wins), "occurrences")
    spans = found.groupBy("rid", "start").agg(F.max("len").alias("len"))
    order = Window.partitionBy("rid").orderBy("start")
    reached = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    hits = spans.select("rid", new.alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    held = found.select("rid", "wid").distinct().join(wins.select("wid", "item_id"), "wid").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    listed = held.groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    listed = listed.select("rid", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return index, hits.join(listed, "rid")


@finished("decontaminated")
def decontaminate(docs: DataFrame, items: DataFrame, least_items: int = 2) -> DataFrame:
    """Per document: words, words hit, items with occurring windows, their hash, and whether ``least_items`` are reached.

    Null and wordless texts have no hits; an empty benchmark hits nothing; of an item with a
    null id the windows count, and the id is left out of the hash.
    """
    index, hits = contamination(docs, items)
    out = lengths(index).join(hits, "rid", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    count = F.coalesce("n_items", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), count.alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (count >= least_items).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, least_items: int = 2) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    named = keyed(docs)
    with scratch(docs.sparkSession):
        found = decontaminate(named.select(F.col("__tf_key").alias("doc_id"), "text"), items, least_items)
        bad = materialise(found.where("contaminated").select(F.col("doc_id").alias("__tf_key")), "contaminated", keep=True)
    return without(named, bad, "__tf_key").select(*docs.columns)
