"""Near duplicates, fingerprints and lines against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, fingerprints, jaccard_join, line_dedup
from tidemark.llm.common import read
from tidemark.llm.components import components, forest
from tidemark.llm.registry import ORACLE_SQL, QUERIES

from .conftest import DATA, texts


def roots(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs, k=4, level=85):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= level * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(links, ids).items()}


def joined(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, **more).collect()}


def family(rng, n, size, change, start):
    """A text and copies with up to `change` words altered."""
    base = [f"w{rng.randint(0, 9999)}" for _ in range(size)]
    out = {}
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, change)):
            own[rng.randrange(size)] = f"z{rng.randint(0, 9999)}"
        out[start + i] = " ".join(own)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = family(rng, 40, 120, 6, 0) | family(rng, 30, 60, 2, 100) | family(rng, 20, 300, 25, 200) | family(rng, 25, 8, 1, 300)
    shared = " ".join(f"common{i}" for i in range(40))
    docs |= {400 + i: shared + " " + " ".join(f"own{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))) for i in range(60)}
    docs |= {500 + i: docs[i * 3] for i in range(8)}
    got = joined(texts(spark, [(i, t, "a") for i, t in docs.items()]).repartition(5))
    assert got == brute(docs)


def test_join_finds_chains(spark):
    """Each text is near the next only; the whole chain is one component."""
    words = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(words[i * 8 : i * 8 + 200]) for i in range(20)}
    want = brute(docs)
    assert len({c for _, c in want.values()}) == 1
    assert joined(texts(spark, [(i, t, "a") for i, t in docs.items()])) == want


def test_join_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(103)]
    sets = {0: words, 1: words[:-15], 2: words[:-16]}  # 100 shingles; 85 and 84 of them
    got = joined(texts(spark, [(i, " ".join(t), "a") for i, t in sets.items()]))
    assert got[1] == (85, 0) and got[2][1] in (0, 2) and got == brute({i: " ".join(t) for i, t in sets.items()})


def opposite(n):
    """A word of a and b and its mirror that polynomials modulo a power of two can't tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_join_tells_built_words_apart(spark):
    a, b = opposite(2048)
    assert joined(texts(spark, [(1, a, "x"), (2, b, "x"), (3, f"q {a} r s", "x"), (4, f"q {b} r s", "x"), (5, a.upper(), "x")])) == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


@pytest.mark.parametrize("k,level", [(5, 80), (4, 85)])
def test_join_with_hot_shingles(spark, monkeypatch, k, level):
    """Postings of frequent shingles are dealt over several tasks."""
    monkeypatch.setattr(jaccard_join, "HOT", 10)
    monkeypatch.setattr(jaccard_join, "PARTNERS", (2, 2, 2))
    rng = random.Random(11)
    sentences = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(14)]
    docs = {i: " ".join(rng.sample(sentences, 8)) for i in range(150)} | family(rng, 30, 100, 9, 300)
    assert joined(texts(spark, [(i, t, "a") for i, t in docs.items()]), k=k, similarity=level) == brute(docs, k, level)


@pytest.mark.parametrize("seed", range(2))
def test_pipeline_parameters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = family(rng, 40, 120, 6, 0) | family(rng, 30, 60, 3, 100) | family(rng, 25, 8, 1, 300) | family(rng, 20, 250, 25, 200)
    df = texts(spark, [(i, t, "a") for i, t in docs.items()])
    want = brute(docs, 5, 80)
    assert joined(df, k=5, similarity=80) == want
    assert {r["doc_id"] for r in jaccard_join.one_of_each(df, k=5, similarity=80).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_rows_that_repeat_an_id_are_documents(spark):
    rng = random.Random(4)
    t, u, v = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(3))
    rows = [(1, t, "a"), (5, t, "a"), (5, u, "a"), (5, u, "b"), (7, v, "a"), (None, v, "a"), (None, None, "a"), (None, "", "a")]
    got = sorted(((r["doc_id"], r["component_id"], r["class_id"]) for r in jaccard_join.near_duplicates(texts(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (5, 1, 1), (5, 5, 5), (5, 5, 5), (7, 7, 7), (None, None, None), (None, None, None), (None, None, None)], key=repr)
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(texts(spark, rows)).collect())
    assert kept == Counter([(1, t), (5, u), (7, v), (None, None), (None, "")])


def test_join_query(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, DATA, "documents").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op2_ngram_jaccard_join"](spark, DATA).collect()} == brute(docs)


def by_sql(name: str, table: str, df) -> list[tuple]:
    con = duckdb.connect()
    con.register(table, df.toArrow())
    got = con.execute(ORACLE_SQL[name])
    order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


def by_name(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_join_equals_sql(spark, odd):
    assert by_name(QUERIES["op2_ngram_jaccard_join"](spark, DATA)) == by_sql("op2_ngram_jaccard_join", "documents", read(spark, DATA, "documents"))
    assert by_name(jaccard_join.near_duplicates(odd)) == by_sql("op2_ngram_jaccard_join", "documents", odd.select("doc_id", "text"))
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join([*base[:100], *(f"x{i}_{j}" for j in range(i // 2))])) for i in range(24)] + [(50, None), (51, " ".join(base))]
    df = spark.createDataFrame(near, "doc_id long, text string")
    assert by_name(jaccard_join.near_duplicates(df)) == by_sql("op2_ngram_jaccard_join", "documents", df)


def test_join_odd_rows(spark, odd, empty):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["component_id"] == got[-7]["component_id"] == -7 and got[2]["n_shingles"] == got[3]["n_shingles"] == got[4]["n_shingles"] == 0
    assert got[2]["component_id"] == 2 and got[4]["component_id"] == 4 and got[None]["component_id"] is None
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = " ".join(f"w{i % 313}" for i in range(4000))
    whole = jaccard_join.shingle_sets([text, "a b c d e", text[:-3]])
    monkeypatch.setattr(jaccard_join, "SEGMENT", 1000)
    assert all((a == b).all() for a, b in zip(whole, jaccard_join.shingle_sets([text, "a b c d e", text[:-3]]), strict=True))


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(3000)]
    got, _ = jaccard_join.word_hashes(np.frombuffer(" \t".join(words).encode(), np.uint8))
    seen = defaultdict(set)
    for w, h in zip(words, got.tolist(), strict=True):
        seen[w].add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(100)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901 + i) for i in range(80)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(4)
    want = {n: r for n, r in roots(links, {x for e in links for x in e}).items() if n != r}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert {r["node"]: r["root"] for r in components(df, at_once=3).collect()} == want
    a, b = forest(np.array([x for x, _ in links]), np.array([y for _, y in links]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want


def vectors(spark, x):
    return spark.createDataFrame([(i, v) for i, v in x.items()], "vec_id long, embedding array<double>")


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = {i: v.tolist() for i, v in enumerate(rng.normal(size=(900, 16)))}
    for k in range(40):
        near = np.array(x[k]) + rng.normal(scale=0.12, size=16)
        x[1000 + k] = near.tolist()
    x |= {2000 + i: x[3] for i in range(50)} | {3000 + i: (np.array(x[7]) * 2 + rng.normal(scale=0.05, size=16)).tolist() for i in range(60)}
    ids = sorted(x)
    m = np.array([x[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    r = roots([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)], ids)
    got = {v["vec_id"]: v for v in embeddings.near_duplicates(vectors(spark, x).repartition(6)).collect()}
    found, true = sum(v["n_links"] for v in got.values()), int(near.sum())
    assert 0.97 * true <= found <= true and all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(1).tolist(), strict=True))
    assert sum(got[i]["component_id"] != r[i] for i in ids) <= 3
    assert all(v["kept"] == (v["vec_id"] == v["component_id"]) for v in got.values())


def test_traversal_visits_cells_by_distance():
    rng = np.random.default_rng(2)
    index = embeddings.MultiIndex(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)), 12)
    x = rng.normal(size=(20, 6))
    a, b = index.halves(x)
    for row, cells in enumerate(index.cells(x)):
        every = (a[row][:, None] + b[row][None, :]).ravel()
        assert np.allclose(every[cells], np.sort(every)[:12])
        assert index.ranks(x[row : row + 1], cells[5:6])[0] == 5


def plain_links(x, cosine=0.95):
    """vec_id -> (n_links, component_id) by all pairs of one length."""
    ids = sorted(x)
    unit = {i: np.array(x[i], float) / np.linalg.norm(x[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(x[a]) == len(x[b]) and unit[a] @ unit[b] >= cosine]
    n = Counter(i for link in links for i in link)
    return {i: (n[i], r) for i, r in roots(links, ids).items()}


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = {1: [1.0, 0.0], 2: None, 3: [0.0, 0.0], 4: [nan, 1.0], 5: [inf, 1.0], 6: [1.0, None], 7: [1e200, 1e-9], 8: [2.0, 0.0], 9: [1.0, 2.0, 3.0], 10: [], 11: [1e-200, 0.0], 12: [1.0, 2.0, 3.1], 13: [5.0], 14: [-1.0], 15: [2.0]}
    df = vectors(spark, x).withColumn("n", F.lit("?")).withColumn("cls", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 10, 14))
    assert got[1] == (3, 1, True) and got[8] == (3, 1, False) and got[7][0] == got[11][0] == 3
    assert got[9] == (1, 9, True) and got[12] == (1, 9, False) and got[13] == (1, 13, True) and got[15] == (1, 13, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(vectors(spark, {1: [0.0]})).first()["n_links"] == 0


def test_vectors_with_null_and_equal_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    assert got[None, 0, None, False] == 1 and got[4, 1, 4, True] == 2 and sum(got.values()) == 5


def test_vectors_of_several_lengths_use_an_index_each(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "FEW", 30)
    rng = np.random.default_rng(9)
    x = {}
    for d, start in ((8, 0), (12, 1000)):
        for i in range(150):
            x[start + i] = rng.normal(size=d).tolist()
        for i in range(50):
            x[start + 500 + i] = (np.array(x[start + i]) + rng.normal(scale=0.08, size=d)).tolist()
    x |= {5000 + i: rng.normal(size=3).tolist() for i in range(25)}
    want = plain_links(x)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(vectors(spark, x)).collect()}
    assert sum(got[i] != want[i] for i in x) <= 4 and all(got[i] == want[i] for i in x if i >= 5000)


def test_vectors_query(spark):
    x = {r["vec_id"]: list(r["embedding"]) for r in read(spark, DATA, "embeddings").collect()}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op4_embedding_near_dedup"](spark, DATA).collect()} == plain_links(x)


def test_vectors_equal_sql(spark):
    assert by_name(QUERIES["op4_embedding_near_dedup"](spark, DATA)) == by_sql("op4_embedding_near_dedup", "embeddings", read(spark, DATA, "embeddings"))
    rng = np.random.default_rng(5)
    made = []
    for i in range(40):
        x = rng.normal(size=8)
        made += [(4 * i + j, (x + j * 0.12 * rng.normal(size=8)).tolist()) for j in range(4)]
    nan = float("nan")
    made += [(500, None), (501, []), (502, [0.0] * 8), (503, [nan] + [1.0] * 7), (504, [None] + [1.0] * 7), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (None, made[0][1]), (1000, made[0][1]), (1000, made[4][1])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    want = by_sql("op4_embedding_near_dedup", "embeddings", df)
    assert by_name(embeddings.near_duplicates(df)) == want and sum(r[2] > 0 for r in want) > 60


@pytest.mark.parametrize("pairs", [0, 3000])
def test_recall_of_planted_pairs_over_many_rows(spark, pairs):
    """24,000 clustered vectors; pairs planted from the threshold upwards, or only so few that probing hardly sees any."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 24_000)] * 0.7 + rng.normal(size=(24_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = max(pairs, 200)
    away = rng.normal(size=(n, 32))
    away -= (away * x[:n]).sum(1, keepdims=True) * x[:n]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.99 if pairs else 0.955, size=(n, 1))
    x = np.concatenate((x, cosine * x[:n] + np.sqrt(1 - cosine**2) * away))
    near = np.zeros(len(x), np.int64)
    for k in range(0, len(x), 2000):
        near[k : k + 2000] = (x[k : k + 2000] @ x.T >= 0.95).sum(1) - 1
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float64()))})
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(table).repartition(8)).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near).all() and found.sum() >= 0.96 * near.sum() > 0


def test_codebooks_grow_with_the_rows():
    assert [embeddings.codes_for(n) for n in (0, 12_000, 10**9, 10**11)] == [2, 32, 9129, 91287]


def similarity(a, b):
    x, y = shingles(a, 5), shingles(b, 5)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprint_query(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in read(spark, DATA, "documents").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, DATA).collect()}
    off, seen = [], {}
    for (i, t), (_, nxt) in zip(docs, [*docs[1:], docs[0]], strict=True):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        off += [r["near_edited"] - similarity(t, edited), r["near_next"] - similarity(t, nxt)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05 and np.abs(off).max() < 0.25


def test_fingerprints_over_many_stretches(spark):
    df = texts(spark, [(i * 37 - 500, f"text {i} of some words {i % 7} more {i % 11} and an end {i}", "a") for i in range(200)]).repartition(7)
    got = fingerprints.with_next(df.select("doc_id", "text"), ["text"], stretch=9)
    rows = got.orderBy("doc_id").collect()
    assert [r["next_text"] for r in rows] == [r["text"] for r in rows[1:]] + [rows[0]["text"]]


def test_fingerprints_with_hot_identifiers(spark):
    rows = [(None, f"text {i % 60} without an id {i % 60}", "a") for i in range(120)] + [(7, f"row {i} of the seventh", "a") for i in range(90)] + [(i, f"own {i}", "a") for i in range(-20, 20)]
    got = fingerprints.with_next(texts(spark, rows).select("doc_id", "text").repartition(6), ["doc_id", "text"], stretch=8).collect()
    key = {t: h for t, h in spark.createDataFrame([(r[1],) for r in rows], "text string").selectExpr("text", "xxhash64(text)").collect()}
    order = sorted(((-(1 << 63) if i is None else i, key[t], t, i) for i, t, _ in rows))
    want = Counter(((a[3], a[2]), (b[3], b[2])) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter(((r["doc_id"], r["text"]), (r["next_doc_id"], r["next_text"])) for r in got) == want


def plain_signature(spark, found, lg=7, words=5, bits=8):
    """One permutation by hand: the least hash of each bin; an empty bin borrows from the full one that a hash of both bins' numbers puts first."""
    import itertools

    schema = "x string"
    tokens = [re.split(r"[\x20\x09-\x0D]+", lower(t).strip(" \t\n\x0b\x0c\r")) for t in found]
    names = sorted({w for own in tokens for w in own})
    of = dict(spark.createDataFrame([(w,) for w in names], schema).selectExpr("x", "xxhash64(x)").collect())
    runs = {tuple(of[w] for w in own[i : i + words]) for own in tokens for i in range(max(1, len(own) - words + 1))}
    hashed = {}
    for n, some in itertools.groupby(sorted(runs, key=len), key=len):
        some = list(some)
        call = f"xxhash64({', '.join(f'h[{i}]' for i in range(n))})" if n == words else "xxhash64(h)"
        hashed |= {tuple(h): x for h, x in spark.createDataFrame([(list(r),) for r in some], "h array<bigint>").selectExpr("h", call).collect()}
    half = 1 << lg - 1
    grid = [(i, j) for i in range(-half, half) for j in range(-half, half)]
    lend = {(i, j): x for i, j, x in spark.createDataFrame(grid, "i long, j long").selectExpr("i", "j", "xxhash64(i, j)").collect()}
    out = []
    for own in tokens:
        least = {}
        for i in range(max(1, len(own) - words + 1)):
            h = hashed[tuple(of[w] for w in own[i : i + words])]
            least[h >> 64 - lg] = min(least.get(h >> 64 - lg, h), h)
        bins = [least[i] if i in least else least[min(least, key=lambda j: (lend[i, j], least[j]))] for i in range(-half, half)]
        out.append("".join(f"{x & (1 << bits) - 1:02x}" for x in bins))
    return out


def test_fingerprints_equal_a_plain_version(spark):
    docs = [r["text"] for r in read(spark, DATA, "documents").orderBy("doc_id").limit(25).collect() if r["text"] and r["text"].strip()] + ["one two", "A b C d E f G"]
    df = fingerprints.with_signature(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "text", "sig")
    got = [r["f"] for r in df.select("doc_id", fingerprints.packed(F.col("sig")).alias("f")).orderBy("doc_id").collect()]
    assert got == plain_signature(spark, docs)


def test_fingerprints_odd_rows(spark, odd, empty):
    got = fingerprints.fingerprints(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "" and by[1]["fingerprint"] == by[-7]["fingerprint"]
    assert len(by[6]["fingerprint"]) == 256 and by[2]["n_chars"] == 0
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(texts(spark, [(1, "just one text of more than five words", "a")])).first()
    assert one["near_next"] == 1.0


def test_fingerprints_use_no_python(spark):
    plan = fingerprints.fingerprints(read(spark, DATA, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_strip(rows, sites, words):
    sources, first = defaultdict(set), {}
    lines = [(i, s, p, x.strip(" \t\r\x0b\x0c")) for i, t, s in rows if t is not None for p, x in enumerate(t.split("\n"))]
    for i, s, p, x in lines:
        if re.findall(r"[^\x20\x09-\x0D]+", x):
            if s is not None:
                sources[x].add(s)
            first[x] = min(first.get(x, (i, p)), (i, p))
    bad = {x for x, s in sources.items() if len(s) >= sites * (1 if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= words else 2)}
    out = {}
    for i, t, _ in rows:
        own = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(own) if not ((k := x.strip(" \t\r\x0b\x0c")) in bad and first[k] != (i, p))]
        out[i] = (len(own), len(own) - len(kept), None if t is None else "\n".join(kept))
    return out


def test_lines_equal_a_plain_version(spark):
    rng = random.Random(6)
    common = [f"common line number {i} of the sites" for i in range(12)]
    rows = []
    for i in range(300):
        own = [rng.choice(common[: 1 + i % 12]) if rng.random() < 0.5 else f"line {rng.randint(0, 60)} that some have too" for _ in range(rng.randint(0, 6))] + ["short"] * (i % 2) + ["All rights reserved."] * (i % 3 == 0) + [" "]
        rows.append((i, "\n".join(own) if i % 50 else None, f"s{i % 23}" if i % 10 else None))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.strip(texts(spark, rows), sites=10).collect()}
    want = plain_strip(rows, 10, 5)
    assert got == want and Counter(bool(n) for _, n, _ in want.values())[True] > 50
    assert sum((t or "").count("All rights") for _, _, t in want.values()) == 1 and sum((t or "").count("short") for _, _, t in want.values()) > 0


def test_many_places_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PLACES", 0)
    rows = [(i, f"own {i}\nthe same line on every site\nend", f"s{i % 12}") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.strip(texts(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\nend" for i in range(1, 40))


def test_lines_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op1_line_dedup"](spark, DATA).collect())) == sorted(duck.execute(ORACLE_SQL["op1_line_dedup"]).fetchall())


def test_lines_odd_rows(spark, odd, empty):
    got = line_dedup.strip(odd, sites=1)
    assert got.count() == 10 and set(odd.columns) <= set(got.columns) and got.select("_id").distinct().collect()[0][0] == "?"
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["text"] is None and rows[3]["n_lines"] == 1 and rows[-7]["n_removed"] == 0 and rows[1]["n_removed"] == 1 and rows[1]["text"] == ""
    assert line_dedup.strip(empty).count() == 0
