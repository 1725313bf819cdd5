"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from the labelled training documents: words whose share of toxic documents stands
out, counted over distinct texts so that copies weigh once. The features of a text are densities of
lexicon words (plain and spelled with other signs), how many stand near a second-person pronoun, and
rates of capitals, punctuation and obfuscation. Trees are boosted by Spark ML on three quarters of the
training rows and calibrated by isotonic regression on the rest. Training uses at most ``max_rows``
labelled rows, those with the smallest hashes of their ids.

Null and empty texts have all features 0 and are scored like others. Rows are neither dropped nor
merged; a null id counts as the empty text in the hold-out. Without labels of both kinds all score 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_mod, table, work_dir, written

#: Second-person pronouns of the four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tu usted ustedes vosotros vuestro".split())
#: Signs that stand for letters in obfuscated spellings.
PLAIN = str.maketrans("013457@$!+", "oieastasit")
FEATURES = ["hits", "density", "weight", "distinct", "near_you", "hidden", "caps", "caps_words", "exclaims", "marks", "obfuscated", "log_words"]
_token = re.compile(r"[^\s]+").findall
_inner = re.compile(r"[^\W\d_][\d@$!*+_.-]+[^\W\d_]|[\d@$!][^\W\d_]+[\d@$!]").search
_strip = ".,;:!?\"'()[]{}<>|*#%&$-_…«»„“”"


def dense(text: str | None, lexicon: dict[str, float], near: int = 5) -> list[float]:
    words = (text or "").lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    bare = [w.strip(_strip) for w in words]
    at = [i for i, w in enumerate(bare) if w in lexicon]
    odd = [(i, w) for i, w in enumerate(words) if not w.isalpha() and not bare[i].isalpha() and _inner(w)]
    hidden = [i for i, w in odd if re.sub(r"[\W\d_]", "", w.translate(PLAIN)) in lexicon or w.translate(PLAIN).strip(_strip) in lexicon]
    you = [i for i in at + hidden if any(w in SECOND_PERSON for w in bare[max(0, i - near):i + near + 1])]
    chars = max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    caps_words = sum(len(w) > 1 and w.isupper() for w in text.split()) if upper > 0.1 * chars else 0
    return [len(at), 100 * len(at) / n, sum(lexicon[bare[i]] for i in at), len({bare[i] for i in at}), len(you), 100 * len(hidden) / n, upper / chars, caps_words / n, 100 * text.count("!") / chars,
            100 * sum(map(text.count, "*#$%&|<>@")) / chars, 100 * len(odd) / n, math.log1p(n)]


def featurise(docs: DataFrame, lexicon: dict[str, float], carried: list[str], text_col: str = "text") -> DataFrame:
    shape = docs.select(*carried).schema
    for f in FEATURES:
        shape = shape.add(f, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([dense(t, lexicon) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=shape.names)

    return docs.select(*carried, F.col(text_col).alias("__text")).mapInArrow(run, shape)


def learn_lexicon(rows: DataFrame, most: int = 300) -> dict[str, float]:
    """Words of ``rows(text, toxic)`` with their log odds; at most ``most``, the most frequent in toxic texts."""
    texts = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    words = texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("w")).where(F.length("w") > 2)
    sizes = texts.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("n")).first()
    odds = F.log((F.col("p") + 0.5) / (sizes["p"] + 1.0)) - F.log((F.col("n") + 0.5) / (sizes["n"] + 1.0))
    found = words.groupBy("w").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("n"))
    found = found.where((F.col("p") >= max(4, 0.02 * sizes["p"])) & (odds >= 1.2)).orderBy(F.desc("p"), "w").limit(most).select("w", odds.alias("odds")).collect()
    return {r["w"]: r["odds"] for r in found}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: object
    calibration: object

    def score(self, docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
        """The carried columns and ``score``, one row for each row of ``docs``."""
        if self.trees is None:
            return docs.select(*carried, F.lit(0.0).alias("score"))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featurise(docs, self.lexicon, carried, text_col))
        rows = self.trees.transform(rows.select(*carried, "features")).withColumn("raw", vector_to_array("probability")[1])
        rows = self.calibration.setPredictionCol("score").transform(rows.drop("prediction", "rawPrediction", "probability"))
        # calibrated steps tie many rows; the raw share keeps their order without crossing 0.5
        score = 0.98 * F.col("score") + 0.02 * F.col("raw")
        score = F.when(F.col("score") >= 0.5, F.greatest(score, F.lit(0.5))).otherwise(F.least(score, F.lit(0.499999)))
        return rows.select(*carried, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 20_000, rounds: int = 20, depth: int = 3) -> ToxicityModel:
    """Fits a model on documents joined with ``labels(doc_id, toxic)``, which hold training rows only."""
    base = work_dir(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("toxic"))
    few = written(marks.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(max_rows), f"{base}/labels")
    rows = written(docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic").where("text is not null"), f"{base}/rows")
    fold = F.pmod(F.xxhash64("text"), F.lit(4))  # copies of a text share a fold
    fit, rest = rows.where(fold != 0), rows.where(fold == 0)
    lexicon = learn_lexicon(fit)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    prepared = written(featurise(fit, lexicon, ["doc_id", "toxic"]).coalesce(4), f"{base}/fit")
    if prepared.select("toxic").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7).fit(assemble.transform(prepared).select("toxic", "features"))
    held = trees.transform(assemble.transform(featurise(rest, lexicon, ["doc_id", "toxic"]))).withColumn("raw", vector_to_array("probability")[1]).select("toxic", "raw")
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw").fit(written(held, f"{base}/held"))
    return ToxicityModel(lexicon, trees, calibration)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", "toxic")
    rows = train(docs, labels).score(docs, ["doc_id"])
    return rows.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
