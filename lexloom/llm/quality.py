"""Quality classifier: compressed sizes under dictionaries of good and of bad text become a calibrated score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import bucket_of, carry, column_bytes, release, slices, table, text_or_empty

#: Labelled rows of each class that a model is fitted on, at most; and their bytes (rows beyond are left out whole).
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 24 << 20
#: Texts are compressed in blocks of so many bytes, so that a dictionary helps the end of a text as much as its start.
BLOCK, LEVEL, DICT_BYTES = 2048, 3, 96 << 10
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        packers = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return lambda texts: predict(self, features(packers, texts))


def features(packers: list, texts: list[bytes]) -> np.ndarray:
    """Of each text: the normalised difference of its compressed sizes (bad less good), and the normalised difference of its
    own size and the smaller one. An empty text has zeros."""
    good, bad = packers
    out = np.zeros((len(texts), 2))
    for i, t in enumerate(texts):
        if t:
            g = b = 0
            for at in range(0, len(t), BLOCK):
                block = t[at : at + BLOCK]
                g += len(good.compress(block))
                b += len(bad.compress(block))
            out[i] = (b - g) / (b + g), 1 - min(b, g) / len(t)
    return out


def _expanded(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -4, 4)
    return np.column_stack([np.ones(len(z)), z, z**2, z[:, 0] * z[:, 1]])


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_expanded(model, x) @ model.weights, -30, 30)))


def fit(good: list[bytes], bad: list[bytes], prior: float = 0.5) -> Model:
    """Dictionaries come from the odd texts, the calibration (logistic, by Newton steps) from the even ones, weighted to the
    prior of class 1."""
    dicts = [_dictionary(texts[1::2] or texts) for texts in (good, bad)]
    model = Model(*dicts, np.zeros(2), np.ones(2), np.zeros(6))
    packers = []
    for content in dicts:
        d = zstandard.ZstdCompressionDict(content)
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    xs = [features(packers, texts[0::2]) for texts in (good, bad)]
    x, y = np.vstack(xs), np.repeat([1.0, 0.0], [len(v) for v in xs])
    if not len(x):
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    a, beta = _expanded(model, x), np.zeros(6)
    ridge = np.diag([1e-3, 1, 1, 1, 1, 1]) * 0.02 * max(1, len(y)) ** 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = beta
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train one, the text itself."""
    blocks = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-DICT_BYTES:] or b"        "


def labelled_sample(docs: DataFrame, labels: DataFrame, target: int, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """Whole texts of at most `rows` training documents with this label, chosen by a hash of their ids, and of at most SAMPLE_BYTES in
    all: sizes come to the driver first, then only the texts that fit. Of rows that share an id the shortest text counts, of ids of one hash
    the smaller comes first. Null texts and ids are the caller's to take out; texts longer than all of SAMPLE_BYTES are passed over;
    empty tables give none; other columns are not looked at."""
    picked = labels.filter(F.col("quality") == target).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    got = docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")  # SAMPLE_ROWS ids
    known = got.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("x"))
    fits, size = [], 0
    for r in sorted(known.select("doc_id", "x.n", "x.h", F.xxhash64("doc_id", F.lit(7)).alias("o")).collect(), key=lambda r: (r["o"], r["doc_id"])):
        if size + r["n"] <= SAMPLE_BYTES:
            fits.append((r["doc_id"], r["h"]))
            size += r["n"]
    if not fits:
        return []
    place = {x: i for i, x in enumerate(fits)}
    wanted = F.broadcast(docs.sparkSession.createDataFrame(fits, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType())])))
    texts = docs.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    return [r["text"].encode() for r in sorted(texts, key=lambda r: place[r["doc_id"], r["h"]])]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on training rows only: crc32(doc_id as text) mod 5 is not 0. Rows with null id, text or label are left out, as are
    ids with both labels."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(bucket_of(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    share = known.agg(F.avg(F.col("quality").cast("double")).alias("p")).first()["p"]
    usable = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    good, bad = (labelled_sample(usable, known, q) for q in (1, 0))
    model = fit(good, bad, 0.5 if share is None else min(max(share, 0.02), 0.98))
    del good, bad
    release()
    return model


def score(docs: DataFrame, model: Model, into: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the probability that a text is good and whether it is THRESHOLD or more (1 or 0), in columns of these names in
    place of any that docs has; one pass, no shuffle.

    Null text counts as empty; very long texts are scored whole, block by block; repeated rows and rows with null ids are scored
    like any other. An empty table gives an empty result."""
    kept = docs.drop(into, predicted)
    carried = carry(docs.sparkSession, model)

    def run(batches):
        predict_all = carried().scorer()
        for batch in slices(batches):
            s = predict_all(column_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], [*batch.schema.names, into, predicted])

    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    return kept.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("text", text_or_empty()), model)
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
