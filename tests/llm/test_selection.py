"""Hard negatives, phrases and mixing against brute force and SQL; nulls, ties, repeats, hot groups, clashing names, empty tables."""

import collections
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.llm import hard_negatives, mixing, phrases

VECTORS = "vec_id long, embedding array<float>, label int"


# hard negatives


def brute_negatives(rows):
    """rows (vec_id, embedding, label), by plain Python integers."""
    live = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, vec, label, v in live:
        if vec % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), other, j, own) for j, other, own, w in live if j != i))
        for s, positive, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(vec, positive, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(hard_negatives.quantised(df)).collect())


def clustered(n, dims, seed, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, dims))
    return [(int(i if ids is None else ids[i]), [float(c) for c in v], int(rng.integers(10))) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # trees of many levels, planes of residuals, several blocks to a cell
        for name, value in (("HELD", 8), ("ASKING", 2), ("LEAF", 4), ("FAN", 2), ("DEPTH", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(700, 6, 1)
    rows += [(800, rows[5][1], 3), (801, rows[5][1], 4), (802, rows[5][1], 4)] + [(900 + i, rows[7][1], i % 2) for i in range(120)]
    rows += [(1300, None, 1), (1400, [1.0, None], 1), (1500, [float("nan")] * 6, 2), (1600, [1.0] * 6, None), (None, [1.0] * 6, 1), (1700, [0.5] * 3, 2), (1800, [], 2), (1900, [0.0] * 6, 1)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 200


def test_hard_negatives_of_rows_that_repeat(spark):
    rows = clustered(60, 4, 2, ids=[100 * (i // 2) for i in range(60)]) + clustered(60, 4, 3)
    rows += rows[:10]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    big = [(100, [3.0e5, -3.0e5], 1), (101, [2.9e5, -3.1e5], 1), (102, [2.0e5, -1.0e5], 2), (103, [1.0e30, 1.0], 2)]
    assert mined(spark, big) == brute_negatives(big[:3]) and len(mined(spark, big)) == 1
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.5], 2)]) == []  # a positive below 0
    df = hard_negatives.quantised(spark.createDataFrame(clustered(250, 4, 4), VECTORS))
    extra = df.select("*", *[F.lit("own").alias(c) for c in ("row", "node", "block", "part", "score", "lo")])
    key = lambda d: sorted(tuple(r) for r in hard_negatives.hard_negatives(d).collect())
    assert key(df) == key(extra) and len(key(df)) > 0


def test_hard_negatives_rule_out_far_nodes():
    """Two far apart groups: nodes of the one are ruled out for anchors of the other."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 3)) + 100, rng.normal(size=(500, 3)) - 100])
    tree = hard_negatives.Tree.fit(x, 3)
    leaves = tree.leaves(x)
    assert set(leaves >> 2) == {2, 3} and len(set((leaves >> 2)[:500])) == 1
    c = tree.centre(np.array([2, 3]), 1)
    least, most = hard_negatives._interval(c[0] @ c[1], 10.0, np.linalg.norm(c[0]), 10.0, np.linalg.norm(c[1]), 200.0, 200.0)
    assert most < 0


# phrases


def brute_phrases(rows, least=100, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0a\x0b\x0c\x0d":
            t = t.replace(c, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    often = {k: v for k, v in f.items() if v >= least}
    longer = collections.Counter()
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) > 1 and longer[lang, w] < a:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:j]] * f[lang, w[j:]]), j) for j in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, x, y, n, -s) for lang, v in found.items() for i, (s, a, p, x, y, n) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("shard", [4 << 20, 4096])
def test_phrases_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "SCANNED", 500)
    rnd = random.Random(3)
    vocabulary = ["the", "The", "of", "a", "É", "日本", "b c", "x\x00y", "it's", "-", "(see)", " ", "ö"]
    join = lambda: rnd.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", "\r\n", "; "])
    rows = [("".join(w + join() for w in rnd.choices(vocabulary, weights=range(13, 0, -1), k=rnd.randrange(0, 60))), rnd.choice(["en", "en", "de", None, "und"])) for _ in range(900)]
    rows += [("a a a a a a a " * 40, "en"), ("New York City council " * 3 + "ends", "de")] + [("we met in New York City council today", "de")] * 120
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("...", "fr"), ("of the " * 30_000, "es")]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5)).collect())
    assert got == brute_phrases(rows) and len(got) > 20 and {r[0] for r in got} == {"en", "de", "es", "und"}
    assert any(r[2] == "we met in new york" for r in got) and not any(r[2] == "new york" for r in got)


def test_phrases_exact_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus that is not there: products of 38 digits, floors and ties."""
    big = {"": 9 * 10**17, "a": 3 * 10**17 + 1, "b": 3 * 10**17 + 2, "c": 10**9 + 1, "a b": 10**17 + 7, "b c": 10**9, "a b c": 10**9 - 1}
    table = spark.createDataFrame([("en", p, f) for p, f in big.items()], "lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "counts", lambda *a: table)
    got = {r["phrase"]: r for r in phrases.collocations(None).collect()}
    assert set(got) == {"a b", "b c", "a b c"}
    assert got["a b"]["score"] == 1000 * big["a b"] * big[""] // (big["a"] * big["b"])
    cuts = [1000 * big["a b c"] * big[""] // (big[x] * big[y]) for x, y in (("a", "b c"), ("a b", "c"))]
    assert got["a b c"]["score"] == min(cuts) and got["a b c"]["l"] == (big["a"] if cuts[0] <= cuts[1] else big["a b"])


def test_phrases_edges(spark):
    df = spark.createDataFrame([("x y " * 100, "en")] * 2, "text string, lang string")
    got = phrases.collocations(df, top=1).collect()
    assert [(r["rank"], r["phrase"], r["a"]) for r in got] == [(1, "y x", 198)] or len(got) == 1
    extra = df.select("*", *[F.lit("own").alias(c) for c in ("shard", "row", "cell", "phrase", "f", "n", "w")])
    assert [tuple(r) for r in phrases.collocations(extra).collect()] == [tuple(r) for r in phrases.collocations(df).collect()]
    assert phrases.collocations(df.limit(0)).count() == 0


# mixing


def test_mixing_equals_sql(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(40))), rnd.choice(["a", "b", "c", "d", None]), "x") for i in range(300)]
    rows += [(1000 + i, "many words here " * 50, "huge", "x") for i in range(100)] + [(7, "same", "tiny", "x")] * 3 + [(None, "no id", "tiny", "x"), (8, None, "none", "x"), (9, "", "", "x"), (10, " \t\n", "blank", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"]).astype({"doc_id": "Int64"}))
    want = con.sql(mixing.ORACLE_SQL).fetchall()
    names = ("doc_id", "size", "source_size", "target", "taken")
    found = mixing.mix(docs)
    assert found.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    out = found.collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, (tuple(r[c] for c in names) for r in out))) == sorted(map(key, want))
    total, by = sum(r["size"] for r in out), collections.defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for own in by.values():
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 1e-6) and own[0]["target"] <= 3 * own[0]["source_size"]
    assert abs(sum(own[0]["target"] for own in by.values()) - total) < 1e-6 * total
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, cap, share the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, of = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else rest * weight[s] / of for s in names}
        above = {s for s in names if s not in full and share[s] >= most * sizes[s]}
        if not above:
            return share
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing_targets_equal_repeated_sharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 5, 1000, 10**6, 10**13]) * rnd.randrange(1, 9) for i in range(40)} | {None: 17, "": 3}
    rows = [(s is None, s or "", n) for s, n in sizes.items()]
    got = {None if r["absent"] else r["name"]: r for r in mixing.targets(spark.createDataFrame(rows, "absent boolean, name string, source_size long")).collect()}
    for s, want in brute_targets(sizes).items():
        assert got[s]["target"] == pytest.approx(want, rel=1e-12) and got[s]["budget"] == pytest.approx(math.floor(want), abs=1 + 1e-12 * want)


def test_mixing_prefix_sums_split_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 5003).alias("k"), F.lit(2).alias("v"))
    out = mixing.prefix_sums(rows, ["g"], ["k"], {"before": F.col("v")})
    assert spark.read.parquet(out.lexloom_path).filter("g = 'hot'").select("_part").distinct().count() > 1
    seen = collections.Counter()
    for r in sorted(out.collect(), key=lambda r: r["k"]):
        assert r["before"] == seen[r["g"]]
        seen[r["g"]] += 2


def test_mixture_holds_what_is_taken(spark):
    rows = [(i, f" lead {'w ' * (i % 9)}end\n", "abc"[i % 3]) for i in range(60)] + [(100 + i, "long text of words " * 20, "d") for i in range(20)] + [(1, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.filter("text IS NOT NULL")).collect()}
    found = collections.defaultdict(list)
    for r in mixing.mixture(docs.filter("text IS NOT NULL")).collect():
        found[r["doc_id"]].append((r["copy"], r["text"]))
    texts = dict((i, t) for i, t, _ in rows if t)
    for i, n in taken.items():
        assert sum(len(t.split()) for _, t in found[i]) == n
        assert [c for c, _ in sorted(found[i])] == list(range(1, len(found[i]) + 1))
        assert all(texts[i].startswith(t) and (t == texts[i] or not t[-1].isspace()) for _, t in found[i])
    assert mixing.mixture(docs).columns == ["doc_id", "text", "source", "copy"]
