"""Quality rules: text counts, and a hashed n-gram log-likelihood ratio of a trusted target against the corpus.

Words and word pairs are hashed into ``buckets``. Two multinomials are counted over all documents, the raw one
over every text and the target one over the trusted ones, both smoothed by one count per bucket. A document's
ratio is the mean over its n-grams of log(target / raw); it is kept when no rule fails and the mean reaches a
fixed threshold. Everything is DataFrame expressions: one pass counts (combined on the map side), one pass
scores; only one row per document and the bucket table are shuffled.

Defined results: a null or empty text has no words, all counts 0, ratio 0 and fails the least-words rule;
repeated rows are separate rows; without trusted documents every ratio is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WORD_ENDS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; ``least_ratio`` is the lowest mean log-likelihood ratio of a kept document."""

    least_words: int = 10
    most_repeat_percent: int = 20
    buckets: int = 1 << 16
    least_ratio: float = -0.2


def words_of(text: Column) -> Column:
    """The runs of ``WORD``: plain replacements and one split, several times faster than matching the runs."""
    for space in WORD_ENDS[1:]:
        text = F.replace(text, F.lit(space), F.lit(WORD_ENDS[0]))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_ENDS[0], -1), "")


def _neighbours(items: Column, size: Column) -> tuple[Column, Column]:
    """The array moved by one place to either side, padded with null."""
    nothing = F.array(F.lit(None))
    return F.concat(nothing, F.slice(items, F.lit(1), size - 1)), F.concat(F.slice(items, F.lit(2), size - 1), nothing)


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and the counts to ``text``; all inside the row, nothing is shuffled.

    Words in repeated windows: the windows' hashes are sorted with their places, neighbours that agree are
    repeats, and each repeated place covers its window up to the next one. Texts without a repeated window,
    nearly all, stop at the comparison of two sizes.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    out = docs.withColumns({"words": words_of(F.col("text")), "lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
    ).drop("lines")
    starts = F.transform("hashes", lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)]))
    whole = F.slice(starts, F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0)))
    out = out.withColumn("windows", F.when(F.size("hashes") > WINDOW, whole)).drop("hashes")
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(repeats, placed)).drop("windows")
    before, after = _neighbours(F.col("placed"), F.size("placed"))
    zipped = F.arrays_zip(F.col("placed").alias("own"), before.alias("before"), after.alias("after"))
    doubled = F.filter(zipped, lambda z: z.own.h.eqNullSafe(z.before.h) | z.own.h.eqNullSafe(z.after.h))
    doubled = F.sort_array(F.transform(doubled, lambda z: z.own.i))
    out = out.withColumn("doubled", F.when(F.col("placed").isNotNull(), doubled)).drop("placed")
    _, following = _neighbours(F.col("doubled"), F.size("doubled"))
    covered = F.zip_with("doubled", following, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("doubled")


def _single(word: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets))


def _pair(words: str, place: str, word: str, buckets: int) -> Column:
    """Bucket of a word and its successor; null at the last word."""
    following = F.get(words, F.col(place) + 1)
    return F.when(following.isNotNull(), F.pmod(F.xxhash64(F.col(word), following), F.lit(buckets)))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """``bucket, ratio``: log of the target over the raw probability, from all documents.

    ``trusted`` holds the ids of the target documents; it grows with the corpus, so it is met by a merge join at
    every size. Join and counts see every row; the counts are combined per task, so at most ``buckets`` rows
    leave a task.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    marked = (
        docs.select("doc_id", "text")
        .join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
        .select(F.col("trusted_id").isNotNull().cast("int").alias("trusted"), words_of(F.col("text")).alias("words"))
        .select("trusted", "words", F.posexplode("words").alias("place", "word"))
    )
    grams = F.array(_single("word", rules.buckets), _pair("words", "place", "word", rules.buckets))
    counts = (
        marked.select("trusted", F.explode(grams).alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    counts = materialize(counts)
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = (total.raw or 0) + rules.buckets, (total.target or 0) + rules.buckets
    ratio = F.log((F.col("target") + 1) / F.lit(target)) - F.log((F.col("raw") + 1) / F.lit(raw))
    return counts.select("bucket", (ratio if total.target else F.lit(0.0)).alias("ratio"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:  # noqa: B008
    """``doc_id``, the counts, ``base_failed``, ``ratio`` (mean log-likelihood ratio), ``kept`` of every row."""
    ratios = F.broadcast(bucket_ratios(docs, trusted, rules))  # at most ``buckets`` rows
    rows = with_counts(docs.select("doc_id", "text")).drop("text").withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "doc_id", *COUNTS]
    grams = rows.select(*keys, "words", F.posexplode_outer("words").alias("place", "word")).select(
        *keys, _single("word", rules.buckets).alias("single"), _pair("words", "place", "word", rules.buckets).alias("pair")
    )
    for name in ("single", "pair"):
        grams = grams.join(ratios.select(F.col("bucket").alias(name), F.col("ratio").alias(f"{name}_ratio")), name, "left")
    total = F.sum(F.coalesce("single_ratio", F.lit(0.0)) + F.coalesce("pair_ratio", F.lit(0.0)))
    scored = grams.groupBy(*keys).agg((total / F.greatest(2 * F.col("n_words") - 1, F.lit(1))).alias("ratio"))
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    ratio = F.round("ratio", 6)
    return scored.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), ratio.alias("ratio"), (~failed & (ratio >= rules.least_ratio)).alias("kept")
    )
