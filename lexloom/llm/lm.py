"""Katz backoff language model of words: Good-Turing discounted counts, exactly normalised backoff weights.

Documents are packed into blocks of text. A block asks for the counts of its distinct words and word pairs, in requests dealt out
by a hash of the key to as many parts as the corpus needs; a part adds up all blocks' counts, which is the stored count table, and
answers each block. So no key is ever shuffled more than once a block, however frequent it is, and nothing of the corpus goes to
the driver but the counts of counts. Backoff weights take a second exchange of the same kind.

P(w | v) is d(c(vw)) c(vw) / c(v) for pairs seen in training, alpha(v) P(w) for others; P(w) is d(c(w)) c(w) / N for known words
and what that leaves for the one class of unknown words. Text starts from a marker that is context only. Words and pairs are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import U64, bucket_of, carry, column_bytes, mix64, shared_table, table, word_hashes

#: Text bytes of a block (a longer text is a block of its own), and bytes of text for each part of a count table.
BLOCK, PART = 8 << 20, 16 << 20
#: Counts up to this one are discounted.
DISCOUNTED = 5
END, START = U64(0x1E5D0F7E47000001), U64(0x57A47F7E47000002)
RESPONSE = "block long, kind int, part int, a binary, b binary"
REQUEST = "kind int, part int, block long, keys binary, x binary, y binary"


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _pack_ids(x: np.ndarray) -> bytes:
    """Byte by byte: frequent words have small ids, so the upper bytes all but vanish."""
    return _pack(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unpack_ids(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(x, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int32)


def _blocks(batches):
    ids, train, texts, size = [], [], [], 0

    def out():
        words, counts = word_hashes(texts)
        ends = np.cumsum(counts + 1)
        tokens = np.full(int(ends[-1]), END, U64)
        inside = np.ones(len(tokens), bool)
        inside[ends - 1] = False
        tokens[inside] = words
        vocabulary, index = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
        order = np.argsort(-np.bincount(index), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        columns = [_pack(counts + 1), _pack(np.array(train, bool)), vocabulary[order].tobytes(), _pack_ids(rank[index[:-1]])]
        return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in columns]], ["ids", "lengths", "train", "vocabulary", "tokens"])

    for batch in batches:
        for i, (t, held) in enumerate(zip(column_bytes(batch, "text"), batch.column(2).to_pylist())):
            ids.append(batch.column(0)[i].as_py()), train.append(not held), texts.append(t)
            size += len(t) + 16
            if size >= BLOCK:
                yield out()
                ids, train, texts, size = [], [], [], 0
    if texts:
        yield out()


@dataclass
class Block:
    """A block read back: everything follows from its four arrays, so all passes number words and pairs alike."""

    lengths: np.ndarray
    train: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        start = int(np.flatnonzero(self.vocabulary == START)[0])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = start
        v = len(self.vocabulary)
        self.pairs, self.pair_of = np.unique(before.astype(np.int64) * v + self.tokens, return_inverse=True)
        self.first, self.second = self.pairs // v, self.pairs % v
        with np.errstate(over="ignore"):
            self.pair_keys = mix64(self.vocabulary[self.first] * U64(31) + mix64(self.vocabulary[self.second]))
        weight = np.repeat(self.train, self.lengths).astype(np.float64)
        self.words_here = np.bincount(self.tokens, weights=weight, minlength=v).astype(np.int64)
        self.words_here[start] = int(self.train.sum())
        self.pairs_here = np.bincount(self.pair_of, weights=weight, minlength=len(self.pairs)).astype(np.int64)

    def per_document(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)


def _deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by part, and where each part begins in it."""
    part = ((keys >> U64(33)) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _requests(kind: int, block: int, parts: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> pd.DataFrame:
    order, cuts = _deal(keys, parts)
    rows = []
    for p in range(parts):
        own = order[cuts[p] : cuts[p + 1]]
        if len(own):
            rows.append((kind, p, block, keys[own].tobytes(), _pack(x[own]), _pack(y[own]) if y is not None else b""))
    return pd.DataFrame(rows, columns=["kind", "part", "block", "keys", "x", "y"]).astype({"kind": "int32", "part": "int32", "block": "int64"})


def _answers(own: pd.DataFrame, keys: np.ndarray, parts: int, column: str, kind) -> np.ndarray:
    order, _ = _deal(keys, parts)
    own = own.sort_values("part")
    out = np.empty(len(keys), kind)
    out[order] = np.concatenate([_unpack(x, kind) for x in own[column]]) if len(own) else np.zeros(0, kind)
    return out


def _counted(key, rows: pd.DataFrame) -> pd.DataFrame:
    """One part of a count table: totals of its keys for each block that asked, with the block that stands for a key; and, under
    block -1, the part's number of keys, their total and its counts of counts."""
    rows = rows.sort_values("block")
    keys = [np.frombuffer(x, U64) for x in rows["keys"]]
    sizes = [len(x) for x in keys]
    distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    here = np.concatenate([_unpack(x, np.int64) for x in rows["x"]])
    total = np.bincount(inverse, weights=here, minlength=len(distinct)).astype(np.int64)
    stands = np.zeros(len(here), bool)
    stands[first] = True
    known = total[(total > 0) & (distinct != START)]
    stats = np.concatenate([[len(known), known.sum()], np.bincount(np.minimum(known, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]]).astype(np.int64)
    answers, cuts = total[inverse], np.cumsum(sizes)[:-1]
    out = [(b, key[0], key[1], _pack(a), _pack(s)) for b, a, s in zip(rows["block"], np.split(answers, cuts), np.split(stands, cuts))]
    return pd.DataFrame([*out, (-1, key[0], key[1], stats.tobytes(), b"")], columns=["block", "kind", "part", "a", "b"])


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0..DISCOUNTED), from the numbers of keys seen once, twice and so on to DISCOUNTED + 1; 1 where Good-Turing gives none."""
    n = np.concatenate([[0], counts]).astype(float)
    d = np.ones(DISCOUNTED + 1)
    if n[1] > 0:
        common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            if n[r] > 0 and common < 1:
                got = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < got < 1:
                    d[r] = got
    return d


@dataclass
class Totals:
    """N, V and discounts of words and pairs; counts of the words that are discounted."""

    tokens: int
    words: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    word_counts: np.ndarray

    def __post_init__(self) -> None:
        self.taken = float(sum(r * self.word_counts[r - 1] * (1 - self.word_discounts[r]) for r in range(1, DISCOUNTED + 1)))
        # without singles to discount, the unknown words get the weight of one token
        self.scale = 1.0 if self.taken > 0 else self.tokens / (self.tokens + 1)
        self.unknown = self.taken / self.tokens if self.taken > 0 else 1 / (self.tokens + 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * _discounted(c, self.word_discounts) / max(1, self.tokens), self.unknown)


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], 1.0)


def backoff(s1: np.ndarray, s2: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, alpha) of contexts, from the sums of P(w | v) and of P(w) over their seen w. A context that Good-Turing takes nothing
    from gives one count of its c + 1 to unseen words; an unseen context gives them all."""
    scale = np.where((c > 0) & (1 - s1 < 1e-9), c / (c + 1.0), 1.0)
    return scale, np.where(c > 0, (1 - scale * s1) / np.maximum(1 - s2, 1e-15), 1.0)


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text); the model
    learns from those whose crc32(doc_id as text) mod folds is not 0.

    Null and empty texts are one end token. Rows that repeat count as often as they stand there; a null id counts as empty text
    in the fold. Without training rows the unknown class has all the mass. A text longer than a block is a block of its own, read whole
    by one task. An empty table gives an empty result; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (bucket_of(F.col("doc_id"), folds) == 0).alias("held"))
    blocks = rows.mapInArrow(_blocks, "ids array<long>, lengths binary, train binary, vocabulary binary, tokens binary")
    blocks = shared_table(spark, blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n_blocks = blocks.count()
    parts = max(8, -(-n_blocks * BLOCK // PART))

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                own = _open(row)
                yield _requests(1, row.block, parts, own.vocabulary, own.words_here)
                yield _requests(2, row.block, parts, own.pair_keys, own.pairs_here)

    one = blocks.select("block", "lengths", "train", "vocabulary", "tokens")
    asked = one.mapInPandas(ask, REQUEST)
    counts = shared_table(spark, asked.groupBy("kind", "part").applyInPandas(_counted, RESPONSE), "counts")
    stats = {1: np.zeros(DISCOUNTED + 3, np.int64), 2: np.zeros(DISCOUNTED + 3, np.int64)}
    for r in counts.filter("block = -1").select("kind", "a").collect():
        stats[r["kind"]] = stats[r["kind"]] + np.frombuffer(r["a"], np.int64)
    totals = carry(spark, Totals(int(stats[1][1]), int(stats[1][0]), discounts(stats[1][2:]), discounts(stats[2][2:]), stats[1][2:]))

    # the blocks and their answers, side by side under the block
    packed = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("tokens").alias("a"), F.col("vocabulary").alias("b"), "lengths", "train", "ids")
    none = [F.lit(None).cast("binary").alias("lengths"), F.lit(None).cast("binary").alias("train"), F.lit(None).cast("array<long>").alias("ids")]
    answered = packed.unionByName(counts.filter("block >= 0").select("*", *none))

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums over the seen pairs that this block stands for, by context."""
        own, t = _opened(rows), totals()
        c1, c2 = (_answers(rows[rows["kind"] == k], x, parts, "a", np.int64) for k, x in ((1, own.vocabulary), (2, own.pair_keys)))
        stands = _answers(rows[rows["kind"] == 2], own.pair_keys, parts, "b", bool) & (c2 > 0)
        p = _discounted(c2, t.pair_discounts) / np.maximum(c1[own.first], 1)
        v = len(own.vocabulary)
        s1 = np.bincount(own.first[stands], weights=p[stands], minlength=v)
        s2 = np.bincount(own.first[stands], weights=t.unigram(c1)[own.second][stands], minlength=v)
        return _requests(3, int(rows["block"].iloc[0]), parts, own.vocabulary, s1, s2)

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, U64) for x in rows["keys"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        sums = [np.bincount(inverse, weights=np.concatenate([_unpack(x, np.float64) for x in rows[c]]), minlength=len(distinct))[inverse] for c in ("x", "y")]
        out = [(b, key[0], key[1], _pack(x), _pack(y)) for b, x, y in zip(rows["block"], *[np.split(s, cuts) for s in sums])]
        return pd.DataFrame(out, columns=["block", "kind", "part", "a", "b"])

    weights = shared_table(spark, answered.groupBy("block").applyInPandas(weigh, REQUEST).groupBy("kind", "part").applyInPandas(add, RESPONSE), "weights")
    complete = answered.unionByName(weights.select("*", *none))

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        own, t = _opened(rows), totals()
        of = {k: rows[rows["kind"] == k] for k in (1, 2, 3)}
        c1, c2 = _answers(of[1], own.vocabulary, parts, "a", np.int64), _answers(of[2], own.pair_keys, parts, "a", np.int64)
        scale, alpha = backoff(*[_answers(of[3], own.vocabulary, parts, c, np.float64) for c in ("a", "b")], c1)
        seen = scale[own.first] * _discounted(c2, t.pair_discounts) / np.maximum(c1[own.first], 1)
        pair = np.log10(np.where(c2 > 0, seen, alpha[own.first] * t.unigram(c1)[own.second]))
        base = np.log10((c1 + 0.1) / (t.tokens + 0.1 * (t.words + 1)))
        ids = rows.loc[rows["kind"] == 0, "ids"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], "Int64"), "held_out": ~own.train, "n_tokens": own.lengths, "n_known": own.per_document((c1[own.tokens] > 0).astype(np.int64)), "train_tokens": t.tokens, "base_score": own.per_document(base[own.tokens]), "score": own.per_document(pair[own.pair_of])})

    return complete.groupBy("block").applyInPandas(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _open(row) -> Block:
    return Block(_unpack(row.lengths, np.int64), _unpack(row.train, bool), np.frombuffer(row.vocabulary, U64), _unpack_ids(row.tokens))


def _opened(rows: pd.DataFrame) -> Block:
    row = rows[rows["kind"] == 0].iloc[0]
    return Block(_unpack(row["lengths"], np.int64), _unpack(row["train"], bool), np.frombuffer(row["b"], U64), _unpack_ids(row["a"]))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
