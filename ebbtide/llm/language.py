"""Language identification: the family first, then one-versus-one linear SVMs inside the family.

A text becomes the square-rooted frequencies of its hashed byte trigrams (letters lower-cased, everything
else a space), scaled to length one. A multinomial logistic model chooses the family, and for every pair of
languages of one family a linear support vector machine votes. Both are fitted by Spark ML on a bounded,
hash-selected sample of the labelled rows; scoring reads every text whole, batch by batch, without a shuffle.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and no family; repeated rows
get equal answers; without labelled rows everything is ``und``; with one label every text with a letter gets
it. A label that is not in ``FAMILIES`` is a family of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import windows_of
from ebbtide.session import materialize

# Families of ISO 639-1 languages.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "indic": "as bn gu hi mr ne or pa si sd ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "austronesian": "fil id jv mg mi ms su tl",
    "sinitic": "zh yue",
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages.split()}

UNDETERMINED = "und"
RESULT = "lang_pred string, score double, family string"
BLOCK = 1 << 20
_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTERS_ONLY = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SPACES = 0x202020


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def trigram_profile(text: str, buckets: int) -> np.ndarray:
    """Unit vector of square-rooted frequencies of the hashed byte trigrams of a whole text."""
    counts = np.zeros(buckets)
    data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b" "
    for piece in windows_of(data, BLOCK, 2):
        a = np.frombuffer(piece, np.uint8).astype(np.uint32)
        grams = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
        grams = grams[grams != _SPACES]
        counts += np.bincount((grams * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(buckets), minlength=buckets)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


@dataclass
class LanguageModel:
    """Weights of the family model (softmax) and of the pairwise machines; a few vectors, whatever the corpus."""

    buckets: int
    languages: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    family_bias: np.ndarray | None = None
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float, str | None]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, None
        x = trigram_profile(text, self.buckets)
        families = list(self.languages)
        sure = np.ones(1)
        if self.family_weights is not None:
            z = self.family_weights @ x + self.family_bias
            sure = np.exp(z - z.max())
            sure /= sure.sum()
        family = families[int(sure.argmax())]
        members = self.languages[family]
        votes, margins = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            weights, bias = self.pairs[a, b]
            margin = float(weights @ x + bias)
            votes[a if margin > 0 else b] += 1
            margins[a] += margin
            margins[b] -= margin
        best = max(members, key=lambda m: (votes[m], margins[m], m))
        within = 1.0 / (1.0 + np.exp(-2.0 * margins[best] / max(1, len(members) - 1))) if len(members) > 1 else 1.0
        return best, float(np.clip(sure.max() * within, 0.0, 1.0)), family


def labelled_sample(train: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` different texts of every label, chosen by a hash of the text, and the labels.

    The text with the smallest hash is always in, so a label is never lost; copies count once.
    """
    rows = train.select("text", "lang").where("text is not null and lang is not null and text rlike '[^\\\\x00-\\\\x40]'")
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect()
    if not known:
        return rows.select("text", "lang").limit(0), []
    limits = F.broadcast(
        train.sparkSession.createDataFrame(
            [(r.lang, max(r.least, int((1 << 40) * min(1.0, per_language / r.n)))) for r in known], "lang string, most long"
        )
    )
    chosen = rows.join(limits, "lang").where("hash <= most").select("text", "lang").distinct()
    return chosen, sorted(r.lang for r in known)


def fit(train: DataFrame, per_language: int = 800, buckets: int = 2048, iterations: int = 15) -> LanguageModel:
    """Fit on ``text`` and ``lang`` of ``train``, from at most about ``per_language`` rows of every label."""
    # only the driver needs these; the tasks that score stay small
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    model = LanguageModel(buckets)
    sample, labels = labelled_sample(train, per_language)
    for label in labels:
        model.languages.setdefault(FAMILY_OF.get(label, label), []).append(label)
    if len(labels) < 2:
        return model
    families = list(model.languages)
    family_index = F.create_map(*[F.lit(x) for f, ls in model.languages.items() for lang in ls for x in (lang, float(families.index(f)))])

    @F.arrow_udf("array<float>")
    def profile(texts: pa.Array) -> pa.Array:
        return pa.array([trigram_profile(t.as_py(), buckets).astype(np.float32) for t in texts], pa.list_(pa.float32()))

    rows = materialize(sample.select("lang", profile("text").alias("profile"), family_index[F.col("lang")].alias("family")))
    rows = rows.withColumn("features", array_to_vector(F.col("profile").cast("array<double>")))
    if len(families) > 1:
        fitted = LogisticRegression(
            labelCol="family", family="multinomial", regParam=1e-4, maxIter=iterations, standardization=False
        ).fit(rows.select("features", "family"))
        model.family_weights, model.family_bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    for members in model.languages.values():
        for a, b in combinations(members, 2):
            pair = rows.where(F.col("lang").isin(a, b)).select("features", (F.col("lang") == a).cast("double").alias("first"))
            machine = LinearSVC(labelCol="first", regParam=1e-4, maxIter=iterations, standardization=False).fit(pair)
            model.pairs[a, b] = machine.coefficients.toArray(), float(machine.intercept)
    return model


def identify(model: LanguageModel, text: Column) -> Column:
    """Struct ``lang_pred, score, family`` of a text column."""
    shared = model

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.predict(t.as_py()) for t in texts]
            columns = zip(*found, strict=True) if found else ([], [], [])
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.string()), strict=True)]
            yield pa.StructArray.from_arrays(arrays, names=["lang_pred", "score", "family"])

    # a deterministic one would be evaluated again in a filter on its result
    return predict.asNondeterministic()(text)
