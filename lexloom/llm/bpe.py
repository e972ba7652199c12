"""Byte-level BPE: merges of a public vocabulary are replayed over all distinct words of a block of the corpus at once.

An inverted index leads from a token pair to the word positions that hold it. Merges are applied in rank order, each to all its
positions, and only the pairs beside a merged position are touched. What a worker has merged it keeps for
the next blocks. Documents are then looked up word by word: one pass over the table, no shuffle, nothing to lose with an
executor but the task it ran.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import carry, column_bytes, release, remembered, slices, table

#: Distinct words whose ids a task remembers from block to block.
REMEMBERED = 800_000
#: New words under one index: so many that it stays in a core's cache.
INDEXED = 8000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank on each line. Read by the driver, sent to executors."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Vocabulary:
    """tokens: bytes by id; pairs: id of what two ids merge to, under first << 32 | second. All 256 bytes have to be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.single = [ranks[bytes([b])] for b in range(256)]
        digest = hashlib.sha256()
        for token, rank in sorted(ranks.items()):
            digest.update(b"%d %d " % (rank, len(token)) + token)
        self.digest = digest.hexdigest()


def replay(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit integers."""
    whole, pair_rank = vocabulary.ranks.get, vocabulary.pairs.get
    translate = vocabulary.single.__getitem__
    out: list[bytes | None] = [None] * len(words)
    ids: list[int] = []
    heads: list[tuple[int, int]] = []
    index: dict[int, list[int]] = {}  # rank of a pair's merge -> positions of its left token
    for w, word in enumerate(words):
        r = whole(word)
        if r is not None:
            out[w] = r.to_bytes(4, "little")
            continue
        heads.append((w, len(ids)))
        ids += map(translate, word)
        ids.append(-1)  # the end of a word, which merges with nothing
    for i, (a, b) in enumerate(zip(ids, ids[1:])):
        if a >= 0 <= b:
            r = pair_rank(a << 32 | b)
            if r is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
    left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))  # neighbours; those of an end are never used
    queue = list(index)
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        rank = pop(queue)
        positions = index.pop(rank, None)
        if positions is None:
            continue
        positions.sort()
        until = -1  # in a word where a lower rank has come up, that one goes first
        again: list[int] = []
        for i in positions:
            a, j = ids[i], right[i]
            if a < 0 or pair_rank(a << 32 | ids[j] if ids[j] >= 0 else -1) != rank:
                continue  # touched by an earlier merge
            if i < until:
                again.append(i)
                continue
            ids[i], ids[j] = rank, -2
            k = right[j]
            right[i] = k
            left[k] = i
            c = ids[k]
            lower = False
            if c >= 0:
                r = pair_rank(rank << 32 | c)
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(queue, r)
                    lower = r < rank
            h = left[i]
            if h >= 0 and (c := ids[h]) >= 0:
                r = pair_rank(c << 32 | rank)
                if r is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        push(queue, r)
                    lower |= r < rank
            if lower:
                until = i
                while ids[until] != -1:
                    until = right[until]
        if again:
            index.setdefault(rank, []).extend(again)
            push(queue, rank)
    for w, at in heads:
        got = []
        while (c := ids[at]) >= 0:
            got.append(c)
            at = right[at]
        out[w] = array("I", got).tobytes()
    return out  # type: ignore[return-value]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        # a Python worker serves many tasks: what it has merged for one it knows for the next
        self.known: dict[str, bytes] = remembered(f"words {vocabulary.digest} {pattern}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts are one block, whose new words are merged together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.find(t) for t in texts]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        gc.disable()  # nothing below makes cycles
        try:
            for at in range(0, len(new), INDEXED):
                part = new[at : at + INDEXED]
                known.update(zip(part, replay(self.vocabulary, [w.encode() for w in part])))
        finally:
            gc.enable()
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        a = array("I")
        a.frombytes(ids)
        return b"".join(map(self.vocabulary.tokens.__getitem__, a))


def _blocks(texts: list[str], size: int = 4 << 20):
    """Runs of whole texts of about `size` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False) -> DataFrame:
    """docs with `ids` (binary: little-endian unsigned 32-bit integers) and `n_tokens`, in place of columns of these names.

    Null text counts as empty: no ids. Repeated rows are encoded alike, very long texts whole; null ids make no difference; an empty
    table gives an empty result. With digests, `ids_sha256` and `decoded_sha256` stand for the ids, which are decoded again for
    the second. A vocabulary without a token for each byte is refused.
    """
    kept = docs.drop("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    carried = carry(docs.sparkSession, (Vocabulary(ranks), pattern))
    release()
    extra = ["ids_sha256", "decoded_sha256"] if digests else ["ids"]

    def run(batches):
        encoder = Encoder(*carried())
        for batch in slices(batches, 4096):
            columns: list[list] = [[], [], []]
            texts = [t.decode() for t in column_bytes(batch, "text")]
            for block in _blocks(texts):
                for ids in encoder.encode(block):
                    columns[0].append(len(ids) // 4)
                    if digests:
                        columns[1].append(hashlib.sha256(ids).hexdigest())
                        columns[2].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    else:
                        columns[1].append(ids)
            types = [pa.int64(), *([pa.string()] * 2 if digests else [pa.binary()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types)]], [*batch.schema.names, "n_tokens", *extra])

    new = [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType() if digests else T.BinaryType()) for c in extra]]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def public_vocabulary(name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, *public_vocabulary(), digests=True).drop("text")
