"""Repeated passages by sparse suffix arrays.

Of each document the suffixes at minimiser positions are kept: in every window of PASSAGE words the position of the least
GRAM-word hash. Equal passages hold equal minimisers, so sorting the kept suffixes brings them next to each other: neighbours
that share a GRAM are compared, and a match is extended left and right, over every passage that the minimiser stands for. A word
is repeated if and only if a run of PASSAGE words around it occurs twice in the table. Passages are told apart by 128 bits of their
words, as is a copy from another text; a GRAM by 64 bits, which only chooses what is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import U64, column_bytes, mix64, shared_table, shingle_hashes, table, word_hashes

PASSAGE, GRAM = 50, 16
#: Suffixes that share a GRAM more often than this are compared passage by passage, all over the cluster, not in one task.
HOT = 20_000


def passages(words: np.ndarray) -> np.ndarray:
    """Two independent hashes of the PASSAGE words from each position, 128 bits that tell passages apart: a polynomial in each of two
    bases, by prefix sums over the mixed hashes of the words."""
    n = max(0, len(words) - PASSAGE + 1)
    out = np.empty((n, 2), U64)
    with np.errstate(over="ignore"):
        for side, base in enumerate((U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))):
            power, total = U64(1), np.zeros(n, U64)
            value = mix64(words ^ (base * U64(side + 1)))
            for i in range(PASSAGE):
                total += value[i : i + n] * power
                power *= base
            out[:, side] = mix64(total)
    return out


def minimisers(gram: np.ndarray) -> np.ndarray:
    """For each passage, the position of its least GRAM hash. Among equals the one chosen before stays as long as it is inside:
    so a text that repeats itself keeps few suffixes."""
    width = PASSAGE - GRAM + 1
    n = len(gram) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(gram, width)
    first = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        first[at : at + (1 << 16)] = view[at : at + (1 << 16)].argmin(axis=1)
    first += np.arange(n)
    value = gram[first]
    out = first.copy()
    for s in np.flatnonzero((value[1:] == value[:-1]) & (first[1:] != first[:-1])) + 1:
        if out[s - 1] >= s:
            out[s] = out[s - 1]
    return out


def _read(texts: list[bytes]):
    words, counts = word_hashes(texts, lower=False)
    at = 0
    for n in counts.tolist():
        yield words[at : at + n]
        at += n


def _sketch(batches):
    """(doc_id, n, digest, grams, at): the kept suffixes of each document, their first GRAM words as a hash."""
    for batch in batches:
        ids, rows = batch.column(0), [[], [], [], []]
        for words in _read(column_bytes(batch, "text")):
            gram = shingle_hashes(words, GRAM)
            at = np.unique(minimisers(gram))
            with np.errstate(over="ignore"):
                place = mix64(words + np.arange(len(words), dtype=U64) * U64(0x9E3779B97F4A7C15))
                digest = place.sum(dtype=U64).tobytes() + np.bitwise_xor.reduce(mix64(place), initial=U64(0)).tobytes()
            for column, x in zip(rows, (len(words), digest, gram[at].tobytes(), at.astype(np.uint32).tobytes())):
                column.append(x)
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows[0], pa.int64()), *[pa.array(x, pa.binary()) for x in rows[1:]]], ["doc_id", "n", "digest", "grams", "at"])


def _suffixes(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        grams = [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
        at = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
        owner = np.repeat(ids, [len(x) for x in at])
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).astype(np.int64)), pa.array(owner), pa.array(np.concatenate(at).astype(np.int32))], ["gram", "doc_id", "at"])


def _extended(batches):
    """(gram, hot, doc_id, start, passages): for each candidate suffix the passages it stands for, from `start` on."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        wanted, hot = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, words in enumerate(_read(column_bytes(batch, "text"))):
            gram = shingle_hashes(words, GRAM)
            own, hashes = minimisers(gram), passages(words)
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(own))
            hot_here = dict(zip(wanted[i], hot[i]))
            doc = batch.column(0)[i].as_py()
            for a, b in zip(starts.tolist(), ends.tolist()):
                p = int(own[a])
                if p in hot_here:
                    for column, x in zip(out, (int(gram[p].astype(np.int64)), hot_here[p], doc, a, hashes[a:b].tobytes())):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["gram", "hot", "doc_id", "start", "passages"])


def _neighbours(batches):
    """Rows come sorted by gram. Of the suffixes that share one, the extended matches are sorted and neighbours compared."""
    held: list[pa.RecordBatch] = []

    def compare(rows: pa.Table) -> pa.RecordBatch:
        blobs = [np.frombuffer(x, U64).reshape(-1, 2) for x in rows.column("passages").to_pylist()]
        sizes = np.array([len(x) for x in blobs], dtype=np.int64)
        flat = np.concatenate(blobs) if blobs else np.zeros((0, 2), U64)
        doc = np.repeat(rows.column("doc_id").to_numpy(), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        start = np.repeat(rows.column("start").to_numpy(), sizes) + np.arange(len(flat)) - np.repeat(first, sizes)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        same = (flat[order][1:] == flat[order][:-1]).all(axis=1)
        again = np.zeros(len(flat), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        d, s = doc[again], start[again]
        return _runs(d, s)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column(0).to_numpy()
        held.append(batch)
        if grams[0] == grams[-1] and (last is None or last == grams[0]):
            last = grams[-1]
            continue
        cut = int(np.searchsorted(grams, grams[-1], side="left")) if grams[0] <= grams[-1] else 0
        if cut == 0 and len(held) == 1:
            last = grams[-1]
            continue
        held[-1] = batch.slice(0, cut)
        yield compare(pa.Table.from_batches([b for b in held if b.num_rows], batch.schema))
        held, last = [batch.slice(cut)], grams[-1]
    if held:
        yield compare(pa.Table.from_batches(held))


def _runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated passages as (doc_id, lo, hi), in words."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(start[at], pa.int64()), pa.array(start[end] + PASSAGE, pa.int64())], ["doc_id", "lo", "hi"])


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, spans) of found (doc_id, lo, hi): in order, those that touch or overlap made one. A window over each document's spans."""
    before = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("hi").over(before)
    rows = found.withColumn("new", F.when(last.isNull() | (F.col("lo") > last), 1).otherwise(0)).withColumn("run", F.sum("new").over(upto))
    runs = rows.groupBy("doc_id", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, n_words): the documents with words in passages of 50 words or more that occur twice or more in docs
    (doc_id, text), in other documents or in the same; spans are (lo, hi) in words, hi exclusive, of n_words in all.

    Words are separated by ASCII white space and compared as they are. Null and empty texts, and texts of fewer than 50 words,
    have no passages. Copies form a class: one of each goes through the suffixes, and all of them are repeated whole. Rows with
    a null id are left out; rows that share an id are read as further copies or texts of that document and their spans united.
    Very long texts are read whole, each by one task. An empty table gives an empty result; other columns are not looked at, whatever
    their names.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = shared_table(spark, docs.mapInArrow(_sketch, "doc_id long, n long, digest binary, grams binary, at binary").filter(F.col("n") >= PASSAGE), "suffixes")
    classes = shared_table(spark, rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    member = rows.select("doc_id", "n", "digest").join(classes, "digest")
    reps = classes.select("digest", F.col("rep").alias("doc_id"))
    single = rows.join(reps, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    suffixes = single.select("doc_id", "grams", "at").mapInArrow(_suffixes, "gram long, doc_id long, at int")
    suffixes = shared_table(spark, suffixes, "sorted")
    shared = suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram", (F.col("c") > HOT).alias("hot"))
    wanted = suffixes.join(shared, "gram").groupBy("doc_id").agg(F.collect_list("at").alias("at"), F.collect_list("hot").alias("hot"))
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "at", "hot")
    extended = shared_table(spark, texts.mapInArrow(_extended, "gram long, hot boolean, doc_id long, start int, passages binary"), "extended")
    found = extended.filter("NOT hot").drop("hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(_neighbours, "doc_id long, lo long, hi long")
    every = extended.filter("hot").mapInArrow(_passage_rows, "passage long, other long, doc_id long, lo long")
    often = every.groupBy("passage", "other").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("passage", "other")
    found = found.unionByName(every.join(often, ["passage", "other"]).select("doc_id", "lo", (F.col("lo") + PASSAGE).alias("hi")))
    whole = member.filter("copies > 1").select("doc_id", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    spans = _merged(found.unionByName(whole).distinct())
    return spans.join(rows.groupBy("doc_id").agg(F.max("n").alias("n_words")), "doc_id")


def _passage_rows(batches):
    for batch in batches:
        blobs = [np.frombuffer(x, U64).reshape(-1, 2) for x in batch.column(4).to_pylist()]
        sizes = np.array([len(x) for x in blobs], dtype=np.int64)
        if not sizes.sum():
            continue
        flat = np.concatenate(blobs)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        start = np.repeat(batch.column(3).to_numpy(), sizes) + np.arange(len(flat)) - np.repeat(first, sizes)
        yield pa.RecordBatch.from_arrays([*[pa.array(flat[:, i].astype(np.int64)) for i in (0, 1)], pa.array(np.repeat(batch.column(2).to_numpy(), sizes)), pa.array(start.astype(np.int64))], ["passage", "other", "doc_id", "lo"])


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that holds a repeated passage; clean documents have none."""
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return found.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), total.alias("n_repeated"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["lo"], x["hi"])), ",").alias("spans"))
