"""A training corpus from raw documents: five stages, each one operator of ``ebbtide.llm`` with its decision.

Every stage takes ``(spark, docs, folder)`` and works on all its predecessor kept; ``run`` writes each result
as Parquet into the shared folder and rereads it. All but the last return the columns of ``docs`` unchanged
in name and type. Null texts and texts without a letter leave at the first stage; repeated rows beyond one of
each near-duplicate group leave at the second; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, language, mixing, pii, shingles, simhash
from ebbtide.llm.common import bounded_batches, read
from ebbtide.llm.queries import DOMAINS, LANGUAGES, MAX_EPOCHS, PII_KEY, SOURCES, domain_of_source
from ebbtide.session import materialize

#: Differing bits of two linked fingerprints.
RADIUS = 2


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told, with the predicted language where ``lang`` is null.

    The model learns from the labelled rows of ``docs``.
    """
    bounded_batches(spark)
    model = language.fit(docs.select("text", "lang"))
    found = docs.withColumn("__found", language.identify(model, F.col("text"))["lang_pred"])
    told = found.where(F.col("__found") != language.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "__found")).drop("__found")


def simhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group of five-word shingles.

    Documents are linked where their SimHash fingerprints differ in at most ``RADIUS`` bits. Fingerprints of texts that share
    four fifths of their shingles lie up to some 20 bits apart, so those of similarity 0.8 or more, confirmed exactly, are linked too.
    """
    bounded_batches(spark)
    return simhash.keep_first(docs, materialize(shingles.grouped(docs.select("doc_id", "text"), radius=RADIUS)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without an exact benchmark window."""
    return decontaminate.keep_clean(docs, read(spark, folder, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with surrogates for personal data and ``n_chars`` of the new text."""
    bounded_batches(spark)
    replaced = pii.replaced(docs, pii.fit(docs, PII_KEY), out="__new").withColumn("text", F.col("__new.text")).drop("__new")
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents and epochs that fill the target weights."""
    weights = {"domain": DOMAINS, "lang": LANGUAGES, "source": SOURCES}
    return mixing.mix(docs, domain_of_source(), weights, (1, 1), MAX_EPOCHS, seed=1)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("mixing", mixing_to_weights),
]

#: The first stage applies fitted classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
