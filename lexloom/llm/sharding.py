"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import U64, fresh, mix64, shared_table, text_or_empty
from lexloom.sources.shared import filesystem

#: Partitions that share a matrix. The driver draws what each group of so many sends to each shard, a task the matrix of its group.
GROUP = 256


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(counts: list[int] | np.ndarray, sizes: np.ndarray, seed) -> np.ndarray:
    """counts[p] rows leave partition p; entry (p, s) of them go to shard s. All row and column sums are exact, and the
    matrix has the law that a uniform random permutation of all rows would induce."""
    rng, left = np.random.default_rng(seed), sizes.copy()
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, need = int(left.sum()), int(n)
        for s in range(len(sizes)):
            rest -= int(left[s])
            got = need if s == len(sizes) - 1 else draw(rng, int(left[s]), rest, need)
            out[p, s] = got
            need -= got
        left -= out[p]
    return out


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: a hypergeometric variate, of populations of any size, by inversion.

    The probabilities around the mode follow from each other by their ratios; what lies beyond 12 standard deviations is less
    than the rounding of the sum.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = 12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5 + 12
    low, high = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    p = np.concatenate(([0.0], np.cumsum(steps)))
    cumulative = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right").clip(0, high - low))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A keyed pseudo-random permutation of 0..n-1, applied to x: a Feistel network that walks its cycles back into range.
    It needs no memory and no sort, so a shard may have any size."""
    x, n, key = (np.asarray(v, dtype=U64) for v in (x, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))).astype(np.int64) + 2) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(rounds):
                left, right = right, left ^ (mix64(right * U64(0x9E3779B97F4A7C15) + key[todo] + U64(r) * U64(0xD1342543DE82EF95)) & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _place(part: np.ndarray, pos: np.ndarray, rows: np.ndarray, cum: np.ndarray, before: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """rows, cum, before: by row of the input (its partition's size, cumulative counts, rows of earlier partitions)."""
    salt = np.full(len(part), seed, dtype=np.int64).astype(U64)
    with np.errstate(over="ignore"):
        here = permuted(pos, rows, mix64(part.astype(U64) * U64(3) + salt))
        shard = (here[:, None] >= cum).sum(axis=1)
        at = np.arange(len(part))
        start = np.where(shard > 0, cum[at, np.maximum(shard - 1, 0)], 0)
        arrived = before[at, shard] + here - start
        slot = permuted(arrived, sizes[shard], mix64(shard.astype(U64) * U64(5) + salt + U64(77)))
    return shard.astype(np.int32), slot


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42, rows_per_file: int = 1_000_000, bytes_per_file: int = 64 << 20) -> DataFrame:
    """All rows of df with `shard` (0..shards-1) and `slot` (gapless from 0 in each shard), exchanged and in slot order.

    Sizes differ by one row at most. Every row goes somewhere, whatever it holds: null ids, empty or very long texts and repeated
    rows are rows like any other, so a group of equal texts is spread over all shards as evenly as any rows are (a group of a
    third of all rows could not lie in one of eight shards of equal counts). An empty table gives an empty result. Columns of df
    named shard or slot are replaced, others kept, whatever their names.

    The driver holds two numbers a partition and a matrix of groups of GROUP partitions; each task draws the matrix of its group,
    which has the same law, given what the group sends to each shard.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    id_, part_, pos_ = (fresh(df, c) for c in ("_id", "_part", "_pos"))
    # Written once, partition and position of a row stay what they are when an executor is lost or the scan is split anew.
    low = (1 << 33) - 1
    staged = df.withColumn(id_, F.monotonically_increasing_id()).withColumns({part_: F.shiftright(id_, 33).cast("int"), pos_: F.col(id_).bitwiseAND(F.lit(low))})
    staged = shared_table(spark, staged.drop(id_), "shards")
    found = sorted((r[0], r[1]) for r in staged.groupBy(part_).agg(F.count(F.lit(1))).collect())
    parts, counts = (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ((), ())))
    sizes = shard_sizes(int(counts.sum()), shards)
    of_groups = [int(counts[at : at + GROUP].sum()) for at in range(0, len(counts), GROUP)]
    matrix = communication_matrix(of_groups, sizes, [seed, 0])
    shared = spark.sparkContext.broadcast((parts, counts, matrix, matrix.cumsum(axis=0) - matrix))
    keep = list(df.columns)

    def place(batches):
        parts, counts, matrix, before = shared.value
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (part_, pos_))
            row = np.searchsorted(parts, part)
            cum, first = np.empty((len(row), len(sizes)), np.int64), np.empty((len(row), len(sizes)), np.int64)
            for g in np.unique(row // GROUP).tolist():
                if g not in drawn:
                    own = communication_matrix(counts[g * GROUP : (g + 1) * GROUP], matrix[g], [seed, 1, g])
                    drawn[g] = own.cumsum(axis=1), before[g] + own.cumsum(axis=0) - own
                here = row // GROUP == g
                cum[here], first[here] = (x[row[here] - g * GROUP] for x in drawn[g])
            shard, slot = _place(part, pos, counts[row], cum, first, sizes, seed)
            # as they are: texts need not become Python objects
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(shard), pa.array(slot)], [*keep, "shard", "slot"])

    placed = staged.mapInArrow(place, T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    fs, at = filesystem(spark, staged.lexloom_path)
    size = int(fs.getContentSummary(at).getLength())
    # a shard is as many partitions, each a run of its slots, as its rows and bytes ask for
    files = max(1, -(-int(sizes.max(initial=0)) // rows_per_file), -(-size // (shards * bytes_per_file)))
    per = max(1, -(-int(sizes.max(initial=1)) // files))
    target = fresh(placed, "_file")
    placed = placed.withColumn(target, (F.col("shard") * files + F.floor(F.col("slot") / per)).cast("int"))
    return placed.repartitionById(shards * files, target).drop(target).sortWithinPartitions("shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt out; size and text_crc32 are those of the text that arrived in the shard."""
    text = text_or_empty().cast("binary")
    dealt = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return dealt.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
