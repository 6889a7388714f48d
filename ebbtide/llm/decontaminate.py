"""Benchmark decontamination through a distributed positional inverted index.

``build_index`` stores postings (term number, document, position) of every training token that occurs in the
benchmark, in segments sorted by term, so a reader of a few terms skips the rest. ``find_matches`` takes each
window of the benchmark to its two rarest terms, intersects their postings after taking the term's place in
the window off the position, and checks the windows that survive against the postings of all other terms at
their offsets. Nothing but the benchmark's own tables, whose rows are counted first, is broadcast.

A match is exact when every term stands at its offset, and a proximity match when every term stands within
``slop`` places of it. Words are runs of ``WORD_CHARS`` after lower-casing A-Z. Only expressions are used.

Defined results: a null or empty text has no words; an item of fewer words than a window, but not none, is one
window; documents and items with equal ids and texts get equal answers, items with equal ids count once; a
null item id counts as empty text; an empty benchmark or table gives no hits.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import broadcast_if_small
from ebbtide.session import materialize

WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SENTINEL = "\x00"
WINDOW = 10
ANCHORS = 2
LENGTH_TERM = -1


def words_of(text: Column) -> Column:
    """Words of a text; texts of one byte per character may use the fast lower-casing."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD_CHARS), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``window_id, item_id, terms`` of all windows of all items; equal windows share their id."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = items.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start"), F.lit(width)).alias("terms")
    )
    return windows.select(F.xxhash64("terms").alias("window_id"), "item_id", "terms").distinct()


def vocabulary(windows: DataFrame) -> DataFrame:
    """``term, term_id`` of the benchmark's words, and the sentinel whose posting holds a document's length."""
    terms = windows.select(F.explode("terms").alias("term")).distinct().select("term", F.xxhash64("term").alias("term_id"))
    end = windows.sparkSession.createDataFrame([(SENTINEL, LENGTH_TERM)], "term string, term_id long")
    return terms.unionByName(end)


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``term_id, doc_id, fp, position``, written to the shared folder in segments sorted by term.

    ``fp`` (a hash of the text) keeps rows apart that share an id but not the text. The posting of the
    sentinel gives the number of words. Each input partition writes its segment; nothing is shuffled.
    """
    words = F.array_append(words_of(F.col("text")), SENTINEL)
    tokens = docs.select("doc_id", F.xxhash64("text").alias("fp"), F.posexplode(words).alias("position", "term"))
    postings = tokens.join(broadcast_if_small(terms), "term").select("term_id", "doc_id", "fp", "position")
    return materialize(postings.sortWithinPartitions("term_id"))


def _key(doc: str = "doc_id") -> Column:
    """Ids compare null-safely through this text."""
    return F.coalesce(F.col(doc).cast("string"), F.lit("\x00"))


def window_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """``window_id, place, term_id, size, rank``: rank 1 is the window's rarest term in the corpus.

    Windows with a term that no document has are gone: nothing can match them.
    """
    frequency = index.groupBy("term_id").agg(F.count("*").alias("n"))
    places = windows.select("window_id", "terms").distinct().select(
        "window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term")
    )
    counted = places.withColumn("term_id", F.xxhash64("term")).drop("term").join(frequency, "term_id", "left")
    by_window = W.partitionBy("window_id")
    alive = counted.withColumn("known", F.count("n").over(by_window)).where("known = size")
    rank = F.row_number().over(by_window.orderBy("n", "place"))
    return materialize(alive.select("window_id", "place", "term_id", "size", rank.alias("rank")))


def find_matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """``window_id, doc_id, fp, start, size, exact`` of all matches, written once."""
    terms = window_terms(windows, index)
    anchors = broadcast_if_small(terms.where(F.col("rank") <= ANCHORS).select("term_id", "window_id", "place", "size", "rank"))
    met = index.join(anchors, "term_id").withColumn("start", F.col("position") - F.col("place"))
    shifts = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])
    first = met.where("rank = 1").select("window_id", "doc_id", "fp", "size", "start", F.lit(0).alias("shift"), "rank")
    later = met.where("rank > 1").select("window_id", "doc_id", "fp", "size", "start", F.explode(shifts).alias("shift"), "rank")
    later = later.select("window_id", "doc_id", "fp", "size", (F.col("start") + F.col("shift")).alias("start"), "shift", "rank")
    starts = (
        first.unionByName(later)
        .where("start >= 0")
        .groupBy("window_id", "doc_id", "fp", "size", "start")
        .agg(
            F.max((F.col("rank") == 1).cast("int")).alias("anchored"),
            F.max((F.col("rank") > 1).cast("int")).alias("met"),
            F.max(((F.col("rank") > 1) & (F.col("shift") == 0)).cast("int")).alias("in_place"),
        )
        .where((F.col("anchored") == 1) & ((F.col("met") == 1) | (F.col("size") == 1)))
        .select("window_id", "doc_id", "fp", "size", "start", ((F.col("in_place") == 1) | (F.col("size") == 1)).alias("exact"))
    )
    candidates = materialize(starts)
    rest = terms.where(F.col("rank") > ANCHORS).select("window_id", "place", "term_id")
    wanted = candidates.join(broadcast_if_small(rest), "window_id").select(
        "window_id", "doc_id", "fp", "start", "size", "term_id", (F.col("start") + F.col("place")).alias("own"), "place"
    )
    wanted = wanted.select("*", F.explode(shifts).alias("shift")).withColumn("position", F.col("own") + F.col("shift"))
    wanted = wanted.select(_key().alias("key"), *wanted.columns).drop("doc_id", "own")
    holders = candidates.select(_key().alias("holder"), F.col("fp").alias("holder_fp")).distinct()
    postings = index.where(F.col("term_id") != LENGTH_TERM).select(_key().alias("key"), "fp", "term_id", "position")
    kept = broadcast_if_small(materialize(holders))
    postings = postings.join(kept, (F.col("key") == F.col("holder")) & (F.col("fp") == F.col("holder_fp")), "left_semi")
    hits = wanted.join(postings, ["key", "fp", "term_id", "position"])
    full = (
        hits.groupBy("key", "fp", "window_id", "start")
        .agg(F.count_distinct("place").alias("near"), F.count_distinct(F.when(F.col("shift") == 0, F.col("place"))).alias("in_place"))
        .withColumnsRenamed({"key": "hit_key", "fp": "hit_fp", "window_id": "hit_window", "start": "hit_start"})
    )
    same = (
        (_key() == F.col("hit_key"))
        & (F.col("fp") == F.col("hit_fp"))
        & (F.col("window_id") == F.col("hit_window"))
        & (F.col("start") == F.col("hit_start"))
    )
    needed = F.greatest(F.col("size") - ANCHORS, F.lit(0))
    joined = candidates.join(full, same, "left").where((needed == 0) | (F.col("near") == needed))
    exact = F.col("exact") & ((needed == 0) | (F.col("in_place") == needed))
    return materialize(joined.select("window_id", "doc_id", "fp", "start", "size", exact.alias("exact")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, items`` (sorted ids of exact items), ``near_items``.

    Words of a document hit by several windows count once. One row per document and position is the most that
    any step makes, and the counts are combined before they are shuffled.
    """
    windows = materialize(benchmark_windows(benchmark, width))
    index = build_index(docs, vocabulary(windows))
    matches = find_matches(index, windows, slop)
    doc = ["doc_id", "fp"]
    exact = matches.where("exact").select(*doc, "start", "size").distinct()
    places = exact.select(*doc, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("position"))
    hits = places.distinct().groupBy(*doc).agg(F.count("*").alias("n_hit"))
    items = matches.join(broadcast_if_small(windows.select("window_id", "item_id")), "window_id")
    items = items.groupBy(*doc, "item_id").agg(F.max("exact").alias("exact"))
    items = items.groupBy(*doc).agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_list(F.when(~F.col("exact"), F.col("item_id")))).alias("near_items"),
    )
    lengths = index.where(F.col("term_id") == LENGTH_TERM).select(*doc, F.col("position").cast("long").alias("n_words"))
    found = _outer(items, hits)
    return _outer(lengths, found).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
    )


def _outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on ``doc_id`` (null-safe) and ``fp``."""
    right = right.withColumn("other_key", _key()).withColumnRenamed("fp", "other_fp").drop("doc_id")
    joined = left.withColumn("own_key", _key())
    joined = joined.join(right, (F.col("own_key") == F.col("other_key")) & joined.fp.eqNullSafe(F.col("other_fp")), "left")
    return joined.drop("own_key", "other_key", "other_fp")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without an exact match, all columns unchanged."""
    windows = materialize(benchmark_windows(benchmark, width))
    matches = find_matches(build_index(docs, vocabulary(windows)), windows)
    hit = matches.where("exact").select(_key().alias("__hit_key"), F.col("fp").alias("__hit_fp")).distinct()
    same = (_key() == F.col("__hit_key")) & (F.xxhash64("text") == F.col("__hit_fp"))
    return docs.join(broadcast_if_small(hit), same, "left_anti")
