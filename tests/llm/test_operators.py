"""Each operator against brute force, round trips or held-out accuracy; nulls, empties, repeats, ties, clashing names, empty tables."""

import array
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, common, connect, containment, embeddings, html_text, lm, near_dup, pii, quality, sharding, suffixes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 50_000), (6, "a b " * 20_000), (7, "same text here"), (8, "same text here"), (8, "same text here"), (None, "same text here"), (9, "日本語 🙂 é\x00 z")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


# sharding


def test_sharding(spark):
    n = 1003
    df = spark.range(n).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("doc_id"), F.lit("clash").alias("shard"), "id").repartition(7)
    out = sharding.shuffle_into_shards(df, 8).collect()
    assert sorted(r["id"] for r in out) == list(range(n))
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {n // 8, n // 8 + 1}
    assert sharding.shuffle_into_shards(df.filter("id < 0"), 8).count() == 0


def test_sharding_digests_are_of_what_arrived(spark, monkeypatch):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    deal, seen = sharding.shuffle_into_shards, []
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df: seen.append(df.columns) or deal(df).withColumn("text", F.concat(F.lit("arrived "), F.coalesce("text", F.lit("")))))
    out = sharding.op7_sharding(spark, SF).collect()
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(seen[0])
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        arrived = b"arrived " + texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(arrived) + 1, zlib.crc32(arrived))


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.range(50).select("id", *[F.concat(F.lit(c), F.col("id")).alias(c) for c in ("_id", "_part", "_pos", "_file", "shard")])
    out = sharding.shuffle_into_shards(df.repartition(3), 4).collect()
    assert sorted((r["id"], r["_id"], r["_part"], r["_pos"], r["_file"]) for r in out) == sorted((i, f"_id{i}", f"_part{i}", f"_pos{i}", f"_file{i}") for i in range(50))


def test_sharding_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = sharding.op7_sharding(spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((r["doc_id"], len((t := (r["text"] or "").encode())) + 1, zlib.crc32(t)) for r in docs)
    per = collections.Counter(r["shard"] for r in out)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in per.items())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


@pytest.mark.parametrize("group", [256, 2])
def test_sharding_groups_of_partitions(spark, monkeypatch, group):
    monkeypatch.setattr(sharding, "GROUP", group)
    dealt = sharding.shuffle_into_shards(spark.range(1000).repartition(7), 3, bytes_per_file=1 << 10)
    assert dealt.rdd.getNumPartitions() > 3
    out = dealt.collect()
    per = collections.Counter(r["shard"] for r in out)
    assert sorted(per.values()) == [333, 333, 334] and len({(r["shard"], r["slot"]) for r in out}) == 1000


def test_matrix_sums():
    counts = [0, 5, 100, 1, 37]
    sizes = sharding.shard_sizes(sum(counts), 4)
    m = sharding.communication_matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes.tolist()


def chi_square(seen, p):
    """Statistic and degrees of freedom, cells of an expectation below 5 put together."""
    n, cells, rest = sum(seen.values()), [], [0, 0.0]
    for k, q in p.items():
        if n * q >= 5:
            cells.append((seen.get(k, 0), n * q))
        else:
            rest = [rest[0] + seen.get(k, 0), rest[1] + n * q]
    cells += [tuple(rest)] if rest[1] > 1 else []
    return sum((a - b) ** 2 / b for a, b in cells), len(cells) - 1


@pytest.mark.parametrize("good,bad,n", [(5, 9, 6), (1, 1, 1), (40, 3, 20), (300, 500, 90)])
def test_draws_have_the_hypergeometric_law(good, bad, n):
    rng = np.random.default_rng(4)
    seen = collections.Counter(sharding.draw(rng, good, bad, n) for _ in range(8000))
    p = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(seen) <= set(p)
    x, dof = chi_square(seen, p)
    assert x < dof + 5 * (2 * max(1, dof)) ** 0.5


def test_draws_of_large_populations():
    rng = np.random.default_rng(6)
    good, bad, n = 3 * 10**11, 7 * 10**11, 10**10
    x = np.array([sharding.draw(rng, good, bad, n) for _ in range(300)], float)
    mean, sd = n * 0.3, (n * 0.21 * (1 - n / 10**12)) ** 0.5
    assert abs(x.mean() - mean) < 5 * sd / 300**0.5 and 0.8 < x.std() / sd < 1.2
    sizes = sharding.shard_sizes(10**13, 8)
    m = sharding.communication_matrix([10**13 // 4] * 4, sizes, 1)
    assert m.sum(axis=0).tolist() == sizes.tolist() and m.sum(axis=1).tolist() == [10**13 // 4] * 4


def test_matrix_has_the_law_of_a_permutation():
    """Two partitions, two shards: the whole matrix follows from one entry, over many seeds."""
    seen = collections.Counter(int(sharding.communication_matrix([6, 4], np.array([5, 5]), s)[0, 0]) for s in range(4000))
    x, dof = chi_square(seen, {k: math.comb(6, k) * math.comb(4, 5 - k) / math.comb(10, 5) for k in range(1, 6)})
    assert x < dof + 5 * (2 * dof) ** 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    x = np.arange(n)
    assert sorted(sharding.permuted(x, np.full(n, n), np.full(n, 99))) == list(range(n))


# quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in scored) / len(scored) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ODD).withColumn("score", F.lit("clash"))
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PARTS = ["a@b.c", "x_y@q-r.co.uk", " ", "1.2.3.4", "255.255.255.0", "1.2.3.256", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+49 30 1234567", "🙂é", ".", "-", "@", "+", "DE89 3704 0044 0532 0130 00", "9", "12", "\n", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "378282246310005", "0000.01.002.3", "("]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_account_numbers_before_other_words(spark):
    number, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    texts = [f"IBAN {number} Please pay", f"{plain} The rest", f"{number} BIC COBADEFF", f"{number} 12 items", f"{number} ok", f"SE24 {number} AND MORE", f"AB12 34567 89012 34 {number}", f"NO93 8601 1117 947 Oslo, GB29 NWBK 6016 1331 9268 19 IN LONDON, é {plain}.", f"{number} {plain}"]
    want = [[number], [plain], [number], [number], [number], [number], [number], ["NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19", plain], [number, plain]]
    docs = docs_of(spark, [*enumerate(texts), (100, f"{plain}12"), (101, f"x{plain}"), (102, "DE88 3704 0044 0532 0130 00 Please")])
    got = {r["doc_id"]: [texts[r["doc_id"]][f["start"] : f["end"]] for f in r["findings"] if f["kind"] == "iban"] if r["doc_id"] < 100 else [tuple(f) for f in r["findings"] if f["kind"] == "iban"] for r in pii.find(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert got[100] == got[101] == got[102] == []
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[0] == "IBAN [iban] Please pay"


def test_pii_equals_plain_regex(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(1500)] + [(9000, None), (9001, "9" * 2000), (9002, "+1" + " " * 2000)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_pii_method(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 no"), (3, "call 555-123-4567 now"), (4, "item 555-123-4567 now")]
    got = {r["doc_id"]: [f["kind"] for f in r["findings"]] for r in pii.find(docs_of(spark, rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["phone_local"], 4: []}
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, [(1, "🙂 a@b.c, 1.2.3.4!"), (2, None)])).collect()}
    assert red == {1: "🙂 [email], [ip]!", 2: None}
    assert pii.find(docs_of(spark, ODD)).count() == len(ODD)


# byte-level BPE


def test_bpe_equals_tiktoken():
    import tiktoken

    ranks, pattern = bpe.public_vocabulary()
    own = bpe.Encoder(bpe.Vocabulary(ranks), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab cdeéß日本🙂\n\t 0123'st.,́\xa0") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += [b"".join(rnd.choices(list(ranks), k=4)).decode("utf8", "ignore") for _ in range(3000)] + ["", "a" * 3000, "ab" * 2000, " " * 500]
    for t, ids in zip(texts, own.encode(texts)):
        a = array.array("I")
        a.frombytes(ids)
        assert list(a) == other.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_bpe_table(spark):
    docs = docs_of(spark, ODD).withColumn("ids", F.lit("clash"))
    out = bpe.encode(docs, *bpe.public_vocabulary(), digests=True).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_bpe_vocabularies_of_one_size_do_not_share_words():
    single = {bytes([b]): b for b in range(256)}
    one, other = ({**single, a: 256, b: 257} for a, b in ((b"ab", b"abc"), (b"bc", b"abc")))
    ids = lambda ranks: list(np.frombuffer(bpe.Encoder(bpe.Vocabulary(ranks), "[a-z]+").encode(["abc abd bcd"])[0], np.uint32))
    assert ids(one) == [257, 256, 100, 98, 99, 100] and ids(other) == [257, 97, 98, 100, 256, 100]
    with pytest.raises(ValueError):
        bpe.Vocabulary({t: r for t, r in single.items() if r != 7})


def test_bpe_empty_table(spark):
    assert bpe.encode(docs_of(spark, ODD).limit(0), *bpe.public_vocabulary()).count() == 0


# repeated passages


def test_suffixes_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (49, 50, 60, 120)]
    texts = []
    for _ in range(60):
        t = [word() for _ in range(rnd.randint(0, 80))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            t += p + [word() for _ in range(rnd.randint(0, 40))]
        texts.append(t)
    texts += [texts[0], ["z"] * 400, ["z"] * 300]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    seen = collections.Counter(tuple(t[s : s + 50]) for t in texts for s in range(len(t) - 49))
    want = {}
    for i, t in enumerate(texts):
        mark = [False] * (len(t) + 1)
        for s in range(len(t) - 49):
            if seen[tuple(t[s : s + 50])] > 1:
                mark[s : s + 50] = [True] * 50
        edges = [j for j in range(len(mark)) if mark[j] != (mark[j - 1] if j else False)]
        if edges:
            want[i] = list(zip(edges[::2], edges[1::2]))
    for hot in (20_000, 2):
        before, suffixes.HOT = suffixes.HOT, hot
        got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.repeated_passages(docs_of(spark, rows)).collect()}
        suffixes.HOT = before
        assert got == want
    assert suffixes.repeated_passages(docs_of(spark, rows).limit(0)).count() == 0


# embeddings


def cosine_links(x):
    u = np.asarray(x, float)
    u /= np.abs(u).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T >= 0.9


def closure(linked):
    least = np.arange(len(linked))
    while (after := np.where(linked, least, len(linked)).min(1)).tolist() != least.tolist():
        least = after
    return least


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(600, 16))
    x = np.float32(np.vstack([base, base[:150] + 0.08 * rng.normal(size=(150, 16)), base[:40], base[:1] * 2]))
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)] + [(9000, None, ""), (9001, [0.0] * 16, ""), (9002, [float("nan")] * 16, ""), (9003, [], ""), (9004, [1.0], ""), (9005, [None] * 16, ""), (None, [float(v) for v in x[0]], "")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")).collect()
    assert len(got) == len(rows)
    got = {r["vec_id"]: r for r in got}
    linked = cosine_links(x)
    assert [got[i]["n_links"] for i in range(len(x))] == (linked.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == closure(linked).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in [*range(9000, 9006), None])
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_lengths_magnitudes_and_shared_ids(spark):
    """Double precision at any magnitude; equal and near vectors of several lengths; rows that share an id."""
    rows = [(1, [1e300, 1e300, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [1e-300, 1e-300, 0.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.000001]), (7, [0.0, 0.0, 1.0]), (7, [0.0, 1.0, 0.0]), (8, [0.0, 0.1, 1.0]), (9, [0.1, 1.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (11, [float("inf"), 1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (10, 0, 10), (11, 0, 11)]
    fine = 0.9 + 1e-12  # beyond single precision
    pair = spark.createDataFrame([(1, [1.0, 0.0]), (2, [fine, (1 - fine**2) ** 0.5]), (3, [fine - 2e-12, -((1 - (fine - 2e-12) ** 2) ** 0.5)])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"]) for r in embeddings.near_duplicates(pair).collect()) == [(1, 1), (2, 1), (3, 0)]


def near_copies(n, dims=64):
    """A third of the rows are noisy copies of one vector, pairwise of cosine 0.9 and more; the others are in families of 4."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n // 6, dims))
    x = np.vstack([base[:1] + 0.2 * rng.normal(size=(n // 3, dims)), np.repeat(base, 4, axis=0) + 0.2 * rng.normal(size=(n // 6 * 4, dims))])
    return np.float32(x[rng.permutation(len(x))])


@pytest.mark.parametrize("most", [1024, 24])
def test_embeddings_near_copies(spark, monkeypatch, most):
    """375 lists on one level or two, those of the group asked by far more rows than a meeting holds."""
    x = near_copies(6000)
    for name, value in (("LIST", 16), ("HELD", 8), ("ASKING", 700), ("MOST", most)):
        monkeypatch.setattr(embeddings, name, value)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    linked = cosine_links(x)
    want = linked.sum(1) - 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(rows).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert np.mean([got[i]["component_id"] == c for i, c in enumerate(closure(linked))]) >= 0.99
    if most == 24:
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows, sure=math.inf).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("kind", ["near copies", "at the threshold"])
def test_embeddings_recall_of_the_margin(kind):
    """Links of 20,000 vectors whose list is asked by one of the two, of 1,250 lists; a fixed number of 16 loses more than half."""
    rng = np.random.default_rng(9)
    x = near_copies(20_000).astype(float)
    if kind == "at the threshold":  # partners of cosine 0.9 to 0.93 in random directions
        x = rng.normal(size=(10_000, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1)[:, None] * x
        side /= np.linalg.norm(side, axis=1)[:, None]
        cos = rng.uniform(0.9, 0.93, len(x))[:, None]
        x = np.vstack([x, cos * x + np.sqrt(1 - cos**2) * side])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embeddings.fit(x[rng.permutation(len(x))[:5000]], 1000)
    lists = len(index.coarse) * len(index.fine)
    asks, own = np.zeros((len(x), lists), bool), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1000):
        margin = np.full(len(own[at : at + 1000]), np.sqrt(0.2) * embeddings.SURE / 8)
        own[at : at + 1000], row, asked = index.lists(x[at : at + 1000], margin)
        asks[at + row, asked] = True
    links = found = 0
    for at in range(0, len(x), 1000):
        i, j = np.nonzero(x[at : at + 1000] @ x.T >= 0.9)
        i, j = i[i + at != j] + at, j[i + at != j]
        links, found = links + len(i), found + (asks[i, own[j]] | asks[j, own[i]]).sum()
    print(f"{kind}: recall {found / links:.4f}, {asks.sum(1).mean():.0f} of {lists} lists asked")
    assert found >= 0.98 * links


# page text


def test_html_held_out():
    pages = html_text.labelled_pages(300, 5)
    field = html_text.train(pages[:200])
    got = [a == b for p, labels in pages[200:] for a, b in zip(field.decode(field.scores(html_text.blocks(p))), labels)]
    assert np.mean(got) > 0.98


def test_html_keeps_what_stands_in_other_elements():
    for tag in ("math", "object", "canvas", "svg", "noscript", "template", "select"):
        assert [t for t, _ in html_text.blocks(f"<p>One</p><{tag}><p>two</p></{tag}><p>three</p>")] == ["One", "two", "three"]
        assert [t for t, _ in html_text.blocks(f"<p>One</p><{tag}><p>two</p><p>three</p>")] == ["One", "two", "three"]
    assert [t for t, _ in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><path d='M0'/></svg>on</p>")] == ["so x=1 and on"]
    for tag in ("script", "style", "iframe", "textarea"):
        assert [t for t, _ in html_text.blocks(f"<p>One</p><{tag}><p>two</p></{tag}><p>three</p>")] == ["One", "three"]


def test_html_pages(spark):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>One\n two&nbsp;three <b>bold.<br><p>Next &lt;p&gt;.</p></article><div class='comments'><p>nice post</p></div><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<<<a<"), (5, "<!-- open"), (6, "<p a='")], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == "A & B\n\nOne two three bold.\n\nNext <p>." and got[2] == got[3] == got[5] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def plain_article(page):
    """What stands in the article element of the driver's pages, by regular expressions."""
    import html

    inside = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)
    parts = re.split(r"</?(?:h[1-6]|p|ul|li|div|article)\b[^>]*>", re.sub(r"<!--.*?-->", "", inside[1], flags=re.S)) if inside else []
    texts = [" ".join(html.unescape(re.sub(r"</?\w+[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_html_equals_the_article_of_each_page(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = html_text.op6_html(spark, sf).collect()
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    for r in out:
        want = plain_article(pages[r["page_id"]] or "")
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_html_repeated_rows_and_columns_of_any_name(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>" + "<p>A sentence that goes on for a while and ends here.</p>" * 3000 + "</article></body>"
    rows = [(1, page, "u", "own"), (1, page, "u", "own"), (None, page, None, "own"), (2, None, "u", "own")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, url string, n_chars string")).collect()
    assert [r["n_chars"] for r in sorted(out, key=lambda r: str(r["page_id"]))] == [len(r["text"]) for r in sorted(out, key=lambda r: str(r["page_id"]))]
    assert sorted((str(r["page_id"]), r["text"].count("A sentence"), r["text"].startswith("Title")) for r in out) == [("1", 3000, True), ("1", 3000, True), ("2", 0, False), ("None", 3000, True)]


def test_html_time_goes_with_length():
    """Pages that stall a parser which looks back or ahead from each tag; and what they mean stays the same."""
    import time

    for page in ("<div class='a%d'>" * 40_000, "<div><b>" * 40_000 + "text</i>" * 40_000, "<p a=\"x" * 60_000, "<a b='>\"" * 60_000, "<" * 200_000, "<b>" * 30_000 + "<p></p>" * 30_000, "x<br " * 60_000, "<li>" * 60_000 + "</ul>" * 60_000):
        for weights in ({"in div": 0.1, "class a": 1.0}, None):
            began = time.process_time()
            html_text.blocks(page, weights)
            assert time.process_time() - began < 3
    page = html_text.labelled_pages(20, 3)[5][0]
    field = html_text.trained()
    assert [t for t, _ in html_text.blocks(page)] == [t for t, _ in html_text.blocks(page, field.weights)]
    assert np.allclose([s for _, s in html_text.blocks(page, field.weights)], field.scores(html_text.blocks(page)))
    assert [t for t, _ in html_text.blocks("<p class='x>y'>one</p><p title=\"a<b>\">two</p>")] == ["one", "two"]
    assert [t for t, _ in html_text.blocks("<p>one</p><p class='x>two</p><p>three")] == ["one", "two", "three"]


# language model


def test_lm_equals_direct_katz(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(8001, None), (8002, ""), (None, "the of"), (8003, "the  The\tOF")]
    got = {r["doc_id"]: r for r in lm.score(docs_of(spark, rows)).collect()}
    uni, pair, ctx, toks = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for i, t in rows:
        w = [*words(t), "</s>"]
        toks[i] = w
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            uni.update(w)
            pair.update(zip(["<s>", *w], w))
            ctx["<s>"] += 1
    ctx.update(uni)
    n, v = sum(uni.values()), len(uni)
    of = lambda c: lm.discounts(np.array([collections.Counter(c.values())[i] for i in range(1, 7)]))
    du, dp = of(uni), of(pair)
    cut = lambda c, d: c * (d[c] if c <= 5 else 1)
    left = 1 - sum(cut(c, du) for c in uni.values()) / n
    p1 = lambda w: cut(uni[w], du) / n if uni[w] else left
    s1, s2 = collections.Counter(), collections.Counter()
    for (a, b), c in pair.items():
        s1[a] += cut(c, dp) / ctx[a]
        s2[a] += p1(b)

    def p2(a, b):
        if not ctx[a]:
            return p1(b)
        k = ctx[a] / (ctx[a] + 1) if 1 - s1[a] < 1e-9 else 1
        return k * cut(pair[a, b], dp) / ctx[a] if pair[a, b] else (1 - k * s1[a]) / (1 - s2[a]) * p1(b)

    assert abs(sum(p2("<s>", w) for w in uni) + p2("<s>", "unknown word") - 1) < 1e-9
    for i, w in toks.items():
        assert math.isclose(got[i]["score"], sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], w)), abs_tol=1e-6)
        assert math.isclose(got[i]["base_score"], sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs_tol=1e-6)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(uni[x] > 0 for x in w), n)
    assert lm.score(docs_of(spark, rows).limit(0)).count() == 0


# near duplicates and components


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dup_equals_brute_force(spark, k):
    rnd = random.Random(8)
    rows = []
    for _ in range(12):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(30, 200))]
        for _ in range(rnd.randint(1, 9)):
            t = list(base)
            for _ in range(rnd.randint(0, 6)):
                t[rnd.randrange(len(t))] = "new" + str(rnd.randint(0, 9))
            rows.append((len(rows), " ".join(t)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, " \n"), (905, "two words"), (906, rows[0][1].upper())]
    want = brute_components(rows, k, 80)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(spark, rows), k, 80).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def family(rnd, members, words, low, high):
    """Copies of one text, each with so many of its words replaced by words of its own."""
    base = ["w" + str(rnd.randrange(10**6)) for _ in range(words)]
    for _ in range(members):
        t = list(base)
        for at in rnd.sample(range(words), rnd.randint(low, high)):
            t[at] = "own" + str(rnd.randrange(10**9))
        yield " ".join(t)


def test_near_dup_families_below_the_threshold(spark):
    """Families of similarity 0.7 that are not links, some that partly are, and a large group of near copies."""
    rnd = random.Random(5)
    texts = [t for args in ((40, 100, 14, 18), (60, 100, 1, 12), (60, 37, 0, 6), (30, 200, 8, 12), (25, 6, 0, 2), (20, 60, 3, 5)) for t in family(rnd, *args)]
    rows = list(enumerate(texts))
    for k in (1, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs_of(spark, rows), k, 80).collect()}
        assert got == brute_components(rows, k, 80)


@pytest.mark.parametrize("percent", [80, 67])
def test_near_dup_filter_loses_no_link(spark, percent):
    """Each set a component of its own, so all that joins them is the filter; and few pairs of families without links pass."""
    rnd = random.Random(percent)
    texts = [t for args in ((30, 100, 2, 14), (40, 31, 0, 5), (30, 7, 0, 2), (30, 90, 30, 34)) for t in family(rnd, *args)]
    sets = {i: set(near_dup.shingle_sets([t.encode()], 1)[0].view(np.int64).tolist()) for i, t in enumerate(texts)}
    held = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "id long, n long, shingles array<long>")
    found = {(r["a"], r["b"]) for r in near_dup._across(held.select("id", F.col("id").alias("c")), held, percent).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert links <= found and not any(a >= 100 and b >= 100 for a, b in found)
    apart = near_dup._across(held.select("id", F.lit(1).cast("long").alias("c")), held, percent)
    assert apart.isEmpty()


def test_near_dup_rows_that_share_an_id(spark):
    rnd = random.Random(2)
    a, b = (" ".join("w" + str(rnd.randrange(10**6)) for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (5, a), (7, a + " more"), (8, b + " other"), (9, "alone in the world"), (None, a), (6, None), (6, a + " more")]
    got = near_dup.near_duplicates(docs_of(spark, rows), 2, 80).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 9), (None, None), (6, 5)}


def test_near_dup_edges(spark):
    out = near_dup.near_duplicates(docs_of(spark, ODD), 2, 80).collect()
    assert len(out) == len(ODD) and {r["component_id"] for r in out if r["doc_id"] in (7, 8)} == {7}
    assert near_dup.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 160), (7, 8), (8, 7), (9, 9), (None, 1)]
    got = {r["id"]: r["component_id"] for r in connect.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()}
    assert got == {i: 5 for i in [5, *range(100, 161)]} | {7: 7, 8: 7}


def test_components_of_several_forests(spark, monkeypatch):
    monkeypatch.setattr(connect, "HELD", 3)
    monkeypatch.setattr(connect, "FEW", 0)
    rnd = random.Random(1)
    edges = [(i, rnd.randrange(max(0, i - 9), i + 1)) for i in range(1, 400) if i % 50]
    want: dict[int, int] = {}
    for a, b in edges:
        want[a] = want.get(b, b) if a != b else want.get(a, a)
    got = {r["id"]: r["component_id"] for r in connect.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()}
    assert got == {i: want.get(i, i) for i in got} and len(got) >= 380


# decontamination


def test_containment_equals_sql(spark):
    con = duckdb.connect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows += [(8001, None), (8002, ""), (8003, "x " + items[0][1].upper() + " y"), (8004, "two words"), (8005, "say two words here")]
    items += [(800, None), (801, ""), (802, "two words")]
    import pandas as pd

    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted((int(r[0]), int(r[1]), r[2], r[3]) for r in con.sql(f"select doc_id, item_id, n_item, n_found from ({containment.ORACLE_SQL})").fetchall())
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:4] for r in containment.contaminated(docs_of(spark, rows), it).collect())
    assert got == want and any(r[0] == 8005 and r[1] == 802 for r in got) and any(r[0] == 8003 for r in got)
    assert containment.contaminated(docs_of(spark, rows), it.limit(0)).count() == 0
    assert containment.contaminated(docs_of(spark, rows).limit(0), it).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    kept = cp.keep_one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    out = cp.run(spark, SF).collect()
    assert 0 < len(out) <= len(want) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_word_hashes_split_like_python():
    texts = [b"a b  A\x0bc", b"", b" x", b"\xc2\xa0y z", b"w" * 5000]
    h, n = common.word_hashes(texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[2] and len(set(h.tolist())) == len(h) - 1


def test_pipeline_equals_plain_python(spark):
    """All five stages over whole texts: scores by the model's own arithmetic, sets, and the tokenizer's library."""
    import tiktoken

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = model.scorer()([(t or "").encode() for t in texts.values()])
    kept = {i: t for (i, t), s in zip(texts.items(), scores) if s >= 0.3}
    kept = {i: kept[i] for i, (_, c) in brute_components(list(kept.items()), 5, 80).items() if i == c}
    shingles = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    items = [(min(5, len(w)), shingles(w, min(5, len(w)))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r["text"]))]
    kept = {i: t for i, t in kept.items() if not any(100 * len(own & shingles(words(t), k)) >= 80 * len(own) for k, own in items)}
    findings = {r["doc_id"]: r["findings"] for r in pii.find(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()}
    for i, t in kept.items():
        out, at = "", 0
        for f in findings[i]:
            if f["start"] >= at:
                out += t[at : f["start"]] + f"[{f['kind']}]"
            at = max(at, f["end"])
        kept[i] = (out + t[at:]) if t else t
    ranks, pattern = bpe.public_vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {i: other.encode_ordinary(t or "") for i, t in kept.items()}
    assert {r["doc_id"]: np.frombuffer(r["ids"], np.uint32).tolist() for r in cp.run(spark, SF).collect()} == want and len(want) > 50


CLASH = ("score", "predicted", "findings", "row", "digest", "_spans", "_hits_email", "_pieces_ip", "Score", "_id")


def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH if c != "Score"])


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination", "personal_data"])
def test_pipeline_keeps_columns_of_clashing_names(spark, stage):
    import corpus_pipeline as cp

    extra = [(30, "write to a@b.c", "en", "s", 3), (31, None, None, None, None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(extra, DOCS))
    run = dict(cp.STAGES)[stage]
    plain, out = run(spark, docs, SF), run(spark, clashing(docs), SF)
    assert out.columns == clashing(docs).columns
    assert sorted(plain.collect(), key=str) == sorted(out.select(plain.columns).collect(), key=str)
    assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH if c != "Score")
    assert run(spark, docs.limit(0), SF).count() == 0


def test_pipeline_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, shared and null ids, by stage."""
    import corpus_pipeline as cp

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, long + " more"), (None, None), (3, ""), (4, " \n"), (4, "\t"), (None, f"so {item} so"), (5, f"so {item} so"), (6, " ".join(f"z{i}" for i in range(30_000)) + " " + item), (7, "one")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    got = lambda stage: sorted(((r["doc_id"], r["text"]) for r in dict(cp.STAGES)[stage](spark, docs, SF).collect()), key=str)
    assert got("near_duplicates") == sorted([rows[0], *rows[4:8], rows[9], *rows[10:]], key=str)
    assert got("decontamination") == sorted([*rows[:8], rows[11]], key=str)
    assert got("personal_data") == sorted(rows, key=str)
    assert set(got("quality")) <= set(rows)
    assert cp.encode_tokens(spark, docs, SF).count() == len(rows) and cp.encode_tokens(spark, docs.limit(0), SF).count() == 0


NAMES = ("_w", "part", "h", "hash", "key", "set", "id", "n", "gram", "block", "list", "held", "score", "spans", "_spans", "findings", "digest", "lang", "ids", "label")


@pytest.mark.parametrize("operator", ["pii", "bpe", "suffixes", "lm", "near_dup", "containment", "quality"])
def test_odd_tables_and_columns_of_any_name(spark, operator):
    """Nulls, empty, blank and long texts, repeated rows, null ids: as many rows with further columns as without; none of an empty table."""
    items = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, None), (None, "one")], "item_id long, text string").withColumn("_w", F.lit("x"))
    long = " ".join(f"v{i % 700}" for i in range(900))
    docs = docs_of(spark, [*ODD, (20, long), (21, long), (21, long), (None, long)])
    vocabulary = bpe.public_vocabulary()
    model = quality.train(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
    run = {
        "pii": lambda d: pii.find(d).select("doc_id", "findings"),
        "bpe": lambda d: bpe.encode(d, *vocabulary).select("doc_id", "ids"),
        "suffixes": suffixes.repeated_passages,
        "lm": lm.score,
        "near_dup": near_dup.near_duplicates,
        "containment": lambda d: containment.contaminated(d, items),
        "quality": lambda d: quality.score(d, model, "_score").select("doc_id", "_score"),
    }[operator]
    rows = lambda df: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    extra = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    plain = rows(run(docs))
    assert plain == rows(run(extra)) and run(extra.limit(0)).count() == 0
    if operator == "suffixes":
        assert {r.split(",")[0][1:] for r in plain} >= {"20", "21"}
    elif operator == "containment":
        assert {(r["doc_id"], r["item_id"]) for r in run(docs).collect()} == {(7, 1), (8, 1)}
    else:
        assert len(plain) == len(ODD) + 4


def test_containment_of_rows_that_share_an_id(spark):
    """What they hold adds up, however small each row is; the same as SQL."""
    import pandas as pd

    item = " ".join(f"i{n}" for n in range(44))
    w = item.split()
    rows = [(1, " ".join(w[:24])), (1, " ".join(w[20:])), (2, item), (3, " ".join(w[:24])), (4, "tiny"), *[(5, " ".join(w[n : n + 5])) for n in range(40)], (6, " ".join(w[:20])), (6, None), (6, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame([(7, item), (8, "tiny")], columns=["item_id", "text"]))
    want = sorted(tuple(r) for r in con.sql(f"select doc_id, item_id, n_item, n_found from ({containment.ORACLE_SQL})").fetchall())
    got = sorted(tuple(r)[:4] for r in containment.contaminated(docs_of(spark, rows), spark.createDataFrame([(7, item), (8, "tiny")], "item_id long, text string")).collect())
    assert got == want and [(r[0], r[1]) for r in got] == [(1, 7), (2, 7), (4, 8), (5, 7)]


def test_containment_meets_by_size(spark):
    """Documents and sketches are joined by the size class as well: no plan meets a short document with a long item."""
    import io
    from contextlib import redirect_stdout

    long, short = " ".join(f"l{n}" for n in range(300)), " ".join(f"l{n}" for n in range(8))
    it = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = containment.contaminated(docs_of(spark, [(1, short), (2, long + " more"), (3, long[:400])]), it)
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(2, 1)]
    shown = io.StringIO()
    with redirect_stdout(shown):
        got.explain()
    assert "ArrowEvalPython" not in shown.getvalue() and "Python" not in shown.getvalue()
