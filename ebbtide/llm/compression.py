"""Quality classifier by compression: dictionaries of good and of bad text, and a calibrated size difference.

Two zstandard dictionaries are trained on a bounded sample of labelled texts. A text is cut into blocks of
``block`` bytes, every block is compressed with each dictionary, and the sizes are added up over the whole
text, so a dictionary helps at the end of a long text as much as at its start. The difference of the sizes,
divided by their sum, goes through a logistic curve fitted on labelled texts that no dictionary has seen.

Defined results: a null or empty text has difference 0 and the score the curve gives there; repeated rows get
equal scores; with fewer than ``LEAST`` texts of either label every score is the share of good labels (0.5
without labels). If a label occurs twice for a document, the lower one counts. An empty table gives no scores; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.llm.common import windows_of
from ebbtide.session import materialize

LEAST = 8
LEVEL = 3
HASHES = 1 << 40
SAMPLE_BYTES = 64 << 20


@dataclass(frozen=True)
class CompressionModel:
    good: bytes | None
    bad: bytes | None
    slope: float
    bias: float
    block: int

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The compressors of one task; they are not shared between processes."""

    def __init__(self, model: CompressionModel):
        self.model = model
        self.good, self.bad = (_compressor(d) if d else None for d in (model.good, model.bad))

    def difference(self, text: str | None) -> float:
        """Positive when the good dictionary compresses the whole text better than the bad one."""
        if not text or self.good is None:
            return 0.0
        good = bad = 0
        for piece in windows_of(text.encode("utf-8", "replace"), self.model.block, 0):
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return (bad - good) / (bad + good)

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.model.slope * self.difference(text) + self.model.bias))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _dictionary(texts: list[str], size: int, block: int) -> bytes:
    """A dictionary trained on blocks; where zstandard finds too little to train on, the raw text itself."""
    samples = [p for t in texts for p in windows_of(t.encode("utf-8", "replace"), block, 0)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a one-variable logistic fit by Newton steps, both classes weighing the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    scale = np.abs(x).max() or 1.0
    design[:, 0] /= scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-4 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Whole texts of at most ``per_label`` documents of each label and at most ``sample_bytes`` of UTF-8 in all of a label.

    The documents with the smallest hashes of their ids are taken, so the sample is the same in every run and
    however the rows lie. A text longer than a sixteenth of ``sample_bytes`` teaches nothing; it is scored like any
    other. Both bounds hold whatever the tables, so the sample may go to the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect() if r.quality in (0, 1)}
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(HASHES)).alias("place")
    parts = []
    for quality in (0, 1):
        # ids below twice the expected hash are far more than enough, so only those are ordered
        most = int(HASHES * min(1.0, (2 * per_label + 100) / max(1, totals.get(quality, 0))))
        near = known.where(F.col("quality") == quality).select("doc_id", "quality", order).where(F.col("place") <= most)
        parts.append(near.orderBy("place", "doc_id").limit(per_label))
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes"))
    fitting = rows.where(F.col("bytes") <= sample_bytes // 16).join(ids, "doc_id")
    picked = materialize(fitting.groupBy("doc_id", "quality", "place").agg(F.max("text").alias("text")))
    sizes = picked.select("doc_id", "quality", "place", F.octet_length("text").cast("long").alias("bytes"))
    so_far = F.sum("bytes").over(W.partitionBy("quality").orderBy("place", "doc_id"))  # at most ``per_label`` rows
    kept = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("doc_id")
    found = picked.join(F.broadcast(kept), "doc_id").orderBy("doc_id").select("text", "quality").collect()
    return [(r.text, int(r.quality)) for r in found]


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = 1500, dictionary: int = 64 << 10, block: int = 1 << 11
) -> CompressionModel:
    """Dictionaries from two thirds of the sample, the curve from the rest."""
    sample = labelled_sample(docs, labels, per_label)
    seen = [(t, y) for i, (t, y) in enumerate(sample) if i % 3]
    unseen = [(t, y) for i, (t, y) in enumerate(sample) if not i % 3]
    good, bad = ([t for t, y in seen if y == q] for q in (1, 0))
    if min(len(good), len(bad)) < LEAST or len({y for _, y in unseen}) < 2:
        share = sum(y for _, y in sample) / len(sample) if sample else 0.5
        share = min(max(share, 0.01), 0.99)
        return CompressionModel(None, None, 0.0, float(np.log(share / (1 - share))), block)
    draft = CompressionModel(_dictionary(good, dictionary, block), _dictionary(bad, dictionary, block), 1.0, 0.0, block)
    scorer = draft.scorer()
    slope, bias = _logistic(np.array([scorer.difference(t) for t, _ in unseen]), np.array([y for _, y in unseen], float))
    return CompressionModel(draft.good, draft.bad, slope, bias, block)


def quality_score(model: CompressionModel, text: Column) -> Column:
    """The calibrated score, 0 to 1, of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield texts.map(scorer.score)

    return score(text)
