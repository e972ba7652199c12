"""Phrase collocations: candidates from sketch upper bounds, compiled into delimiter-guarded automata that scan shards.

The documents are dealt into shards. A first scan counts pairs and triples of neighbouring words in a count-min sketch of one row, which
is held as a table: (cell, shard, n), the cell a 64-bit hash of language and words. A cell's sum bounds from above how often what falls
into it occurs, and a longer phrase occurs no more often than any triple in it. Each shard gets its own cells that reach the threshold;
a second scan counts the shard's words, compiles the phrases whose pairs or triples all have such cells into an automaton, counts their
overlapping matches, and the sums over the shards are exact. So no table of the whole corpus is ever held in one place, and a hash that
two phrases share costs a needless count, never a wrong one.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import U64, column_bytes, forget, mix64, release, shared_table, slices, table, word_hashes

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text to a shard, about: what a shard's automaton holds goes with it.
SHARD = 12 << 20
#: Characters that an automaton is run over at once, so many matches are held.
SCANNED = 1 << 20
#: A-Z in lower case, and what ends a piece as a line feed; the tab as a blank.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _pieces(texts: list[bytes]) -> list[bytes]:
    """The pieces that hold words, in order."""
    return [p for p in b"\n".join(texts).translate(_CLEAN).split(b"\n") if p and not p.isspace()]


def _cells(pieces: list[bytes], lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cell, inside) of the pairs and of the triples that begin at each word: whether they lie within a piece."""
    words, counts = word_hashes(pieces, lower=False)
    seed = U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    owner = np.repeat(np.arange(len(pieces)), counts)
    with np.errstate(over="ignore"):
        one = mix64(words + seed)
        two = mix64(one[:-1] * U64(0x100000001B3) + mix64(one[1:] + U64(2)))
        three = mix64(two[:-1] * U64(0x100000001B3) + mix64(one[2:] + U64(3)))
    return [(two, owner[1:] == owner[:-1]), (three, owner[2:] == owner[:-2])]


def _by_lang(langs: list, texts: list[bytes]) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        if text:
            out.setdefault(lang, []).append(text)
    return out


def _dealt(batches):
    """(shard, lang, text): rows that follow each other share a shard as long as their texts fit."""
    shard, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = size + np.cumsum(np.fromiter((len(x) for x in column_bytes(batch, "text")), np.int64, batch.num_rows))
        before = np.concatenate(([size], ends[:-1]))
        size = int(ends[-1]) if len(ends) else size
        yield pa.RecordBatch.from_arrays([pa.array(shard + before // SHARD), batch.column(0), batch.column(1)], ["shard", "lang", "text"])


def _sketched(batches):
    """(cell, shard, n) of batches (shard, lang, text), summed up for each shard and language as far as rows follow each other."""
    forget()
    held: dict[str, list[bytes]] = {}
    now = None

    def sums():
        for lang, texts in held.items():
            if pieces := _pieces(texts):
                cells, n = np.unique(np.concatenate([c[inside] for c, inside in _cells(pieces, lang)]), return_counts=True)
                for at in range(0, len(cells), 1 << 16):
                    part = cells[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.full(len(part), now)), pa.array(n[at : at + (1 << 16)])], ["cell", "shard", "n"])
        held.clear()

    for batch in slices(batches):
        for shard, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch, "text")):
            if shard != now:
                yield from sums()
                now = shard
            held.setdefault(lang, []).append(text)
    yield from sums()


def _matches(pieces: list[bytes], words: list[bytes], lang: str, often: np.ndarray, longest: int) -> dict[str, int]:
    """How often the phrases of the pieces, whose words are given, occur whose pairs or triples have cells among `often`, which is sorted."""
    import ahocorasick

    has = lambda x: often[np.searchsorted(often, x).clip(0, max(0, len(often) - 1))] == x if len(often) else np.zeros(len(x), bool)
    pair, triple = (has(c) & inside for c, inside in _cells(pieces, lang))
    found: set[bytes] = set()
    run = pair
    for m in range(2, longest + 1):
        found.update(b" ".join(words[i : i + m]) for i in np.flatnonzero(run).tolist())
        run = triple if m == 2 else run[:-1] & triple[m - 2 :]
    if not found:
        return {}
    phrases = [p.decode() for p in found]
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(f" {p} ", i)
    automaton.make_automaton()
    total = np.zeros(len(phrases), np.int64)
    # pieces without such a pair hold none of the phrases
    first = np.cumsum([0, *[len(p.split()) for p in pieces]])
    some = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(pair), [pair.sum()]))[first.clip(0, len(pair))]))
    held, size = [], 0
    for n, k in enumerate(some.tolist(), 1):
        held.append(b" " + b" ".join(words[first[k] : first[k + 1]]) + b" ")
        size += len(held[-1])
        if size >= SCANNED or n == len(some):
            # neighbours share the blank between them, so matches may overlap
            total += np.bincount(np.fromiter((i for _, i in automaton.iter(b"\n".join(held).decode())), np.int64), minlength=len(phrases))
            held, size = [], 0
    return dict(zip(phrases, total.tolist()))


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f) of docs (text, lang): all phrases of up to `longest` words that occur `least` times or more in their language,
    and under the empty phrase the number of its words. Null texts are empty, a null language is `und`; a very long text is the
    last of its shard; an empty table gives an empty result; other columns are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = shared_table(spark, rows.mapInArrow(_dealt, "shard long, lang string, text string"), "dealt")
    sketch = dealt.mapInArrow(_sketched, "cell long, shard long, n long")
    # a cell has a row a shard, or few: its sum is taken where its rows meet, and each shard told of it
    often = sketch.withColumn("most", F.sum("n").over(Window.partitionBy("cell"))).filter(F.col("most") >= least)
    own = shared_table(spark, often.groupBy("shard").agg(F.collect_set("cell").alias("cells")), "cells")

    def scan(key, texts: pa.Table, cells: pa.Table) -> pa.Table:
        often = np.sort(np.array(cells.column("cells")[0].as_py(), np.int64).view(U64)) if cells.num_rows else np.zeros(0, U64)
        out: list[list] = [[], [], []]
        by_lang = _by_lang(texts.column("lang").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist())
        for lang in list(by_lang):
            pieces = _pieces(by_lang.pop(lang))
            if not pieces:
                continue
            words = b"\n".join(pieces).split()
            once = Counter(words)
            found = {"": len(words)} | {w.decode(): n for w, n in once.items()} | _matches(pieces, words, lang, often, longest)
            for column, x in zip(out, ([lang] * len(found), found.keys(), found.values())):
                column.extend(x)
        release()
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "phrase", "f"])

    scanned = dealt.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(scan, "lang string, phrase string, f long")
    every = scanned.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return shared_table(spark, every.filter((F.col("f") >= least) | (F.col("phrase") == "")), "frequent")


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language of docs (text, lang) the `top` phrases of two to `longest` words that
    occur `least` times or more, by their least score over all cuts in two, floor(1000 * a * n / (l * r)).

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at blanks and tabs; a phrase lies within a piece. A phrase that
    stands in a longer candidate whenever it occurs gives way to it. Ties of score go by a, then by the bytes of the phrase; ties of
    cuts to the shorter first part. Null texts hold nothing, a null language counts as `und`; very long texts are read whole, each by
    one task; rows that repeat one count again. Empty tables give an empty result; other columns are not looked at. Quotients are exact
    and rounded down, for languages of up to 10^17 words.
    """
    every = counts(docs, least, longest)
    frequent = every.filter("phrase <> ''")
    candidates = frequent.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w")).filter("m > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(every.filter("phrase = ''").select("lang", F.col("f").alias("n")), "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    scored = cuts.withColumn("score", F.expr(f"CAST(({big('a')} * {big('n')} * CAST(1000 AS DECIMAL(4,0))) div ({big('l')} * {big('r')}) AS BIGINT)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    inside = candidates.filter("m > 2").withColumn("s", F.explode(F.sequence(F.lit(2), F.col("m") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("s") + 1)))
    inside = inside.groupBy("lang", _part(F.col("at"), F.col("s")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", order.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
z AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))))) AS phrase FROM w WHERE len(w) > 0),
f AS (SELECT lang, phrase, count(*)::HUGEINT AS f, len(string_split(phrase, ' ')) AS m FROM g GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
k AS (SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
c AS (
  SELECT k.lang, k.phrase, k.f AS a, k, x.f AS l, y.f AS r, n, 1000 * k.f * n // (x.f * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1 : k.m], ' ') JOIN z ON z.lang = k.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda j: array_to_string(string_split(phrase, ' ')[j : j + s - 1], ' '))))) AS phrase FROM f WHERE m > 2),
o AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM t WHERE rank <= {TOP}
"""
