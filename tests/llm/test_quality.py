"""The quality classifier against all of it done by hand: sample, dictionaries, compressed sizes, calibration and scores."""

import zlib

import numpy as np
import pytest
import zstandard

from lexloom.llm import quality

SF = "/root/testdata/sf0.001"


def by_hand(spark):
    """Scores of all documents: the labelled rows outside the held-out fold, odd texts for dictionaries, even ones for the calibration,
    whose weighted, penalised likelihood is climbed by plain gradient steps instead of Newton's."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    order = spark.createDataFrame([(i,) for i in labels], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 7) AS o").collect()
    order = [r["doc_id"] for r in sorted(order, key=lambda r: (r["o"], r["doc_id"]))]
    texts = {q: [docs[i] for i in order if labels[i] == q] for q in (1, 0)}
    blocks = lambda t: [t[at : at + 2048] for at in range(0, len(t), 2048)]
    packers = []
    for q in (1, 0):
        own = [b for t in texts[q][1::2] for b in blocks(t)]
        try:
            content = zstandard.train_dictionary(96 << 10, own).as_bytes()
        except zstandard.ZstdError:
            content = b"".join(own)[-(96 << 10) :]
        packers.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False))

    def measured(t):
        if not t:
            return 0.0, 0.0
        g, b = (sum(len(p.compress(x)) for x in blocks(t)) for p in packers)
        return (b - g) / (b + g), 1 - min(b, g) / len(t)

    x = np.array([measured(t) for q in (1, 0) for t in texts[q][0::2]])
    y = np.array([q for q in (1, 0) for _ in texts[q][0::2]], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)

    def terms(v):
        u, w = np.clip((v[0] - mean[0]) / scale[0], -4, 4), np.clip((v[1] - mean[1]) / scale[1], -4, 4)
        return [1, u, w, u * u, w * w, u * w]

    prior = sum(labels.values()) / len(labels)
    weight = np.array([prior / (y == 1).sum() if v else (1 - prior) / (y == 0).sum() for v in y]) * len(y)
    a, penalty = np.array([terms(v) for v in x]), np.array([1e-3, 1, 1, 1, 1, 1]) * 0.02 * len(y) ** 0.5
    beta, rate = np.zeros(6), 1 / (np.linalg.norm((a.T * weight) @ a, 2) / 4 + penalty.max())
    momentum = beta.copy()
    for n in range(200_000):
        p = 1 / (1 + np.exp(-(a @ momentum)))
        new = momentum + rate * (a.T @ (weight * (y - p)) - penalty * momentum)
        momentum = new + n / (n + 3) * (new - beta)
        done = np.abs(new - beta).max() < 1e-13
        beta = new
        if done and n > 100:
            break
    return {i: 1 / (1 + np.exp(-(np.array(terms(measured(t))) @ beta))) for i, t in docs.items()}


def test_scores_equal_those_by_hand(spark):
    want = by_hand(spark)
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, SF).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        assert got[i]["score"] == pytest.approx(s, abs=2e-4)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_very_long_texts_and_a_full_sample(spark, monkeypatch):
    """A text of several megabytes is scored by all its blocks; of ties at the sample's limit those of the least hashes are taken."""
    docs = spark.createDataFrame([(i, f"plain words of text number {i} " * (1 + i % 7)) for i in range(1, 60)] + [(100, "zq " * 1_500_000), (101, "zq " * 700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(out) == 61 and all(0 <= s <= 1 for s in out.values())
    order = [r["doc_id"] for r in labels.filter("quality = 1").selectExpr("doc_id", "xxhash64(doc_id, 7) AS o").orderBy("o", "doc_id").collect()]
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert quality.labelled_sample(docs, labels, 1, 5) == [texts[i] for i in order[:5]]
    monkeypatch.setattr(quality, "SAMPLE_BYTES", len(texts[order[0]]) + len(texts[order[1]]))
    assert quality.labelled_sample(docs, labels, 1, 5)[:2] == [texts[i] for i in order[:2]]
