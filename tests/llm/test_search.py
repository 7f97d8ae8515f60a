"""Hard negatives, near duplicates among embeddings and spelling variants against brute force, and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import embedding_dedup, hard_negatives, queries, spelling, topk_search

VECTORS = "vec_id long, embedding array<double>, label int, part string"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def odd_vectors(n, size, seed, spread):
    """Vectors around some centres, and repeated, null, empty and other odd rows."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, size)) * 0.2
    rows = [(i, list(map(float, base[i % 20] + rng.normal(size=size) * spread)), int(i // 3 % 10), "x") for i in range(n)]
    rows += [rows[100]] * 2 + [rows[7]] * 9 + [rows[400]] * 3 + [(None, rows[3][1], 1, "x"), (9000, None, 1, "x"), (9100, rows[3][1], None, "x"), (9200, [float("nan")] * size, 1, "x"), (9300, [], 2, None)]
    rows += [(9500, [1.0, 2.0], 3, "x"), (9501, [1.0, 2.1], 3, "x"), (9502, [1.0, 2.1], 3, "x"), (9503, [1.0, 1.9], 4, "x"), (9400, [0.0] * size, 2, "x"), (9401, [None, *[1.0] * (size - 1)], 2, "x"), (9402, [float("inf"), *[1.0] * (size - 1)], 2, "x")]
    return rows


def quantised(df):
    return topk_search.quantised(df, "vec_id", "embedding", label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def brute_negatives(rows):
    some = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for i, v, label, _ in rows if i is not None and label is not None and usable(v)]
    out = []
    for a, label, q in some:
        if a % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, w)), i, other) for i, other, w in some if i != a and len(w) == len(q))
            for p, s in [(i, -s) for s, i, other in scores if other == label][:5]:
                good = [(i, -t) for t, i, other in scores if other != label and 80 * s <= -100 * t <= 100 * s][:5]
                out += [(a, p, rank, i, s, t) for rank, (i, t) in enumerate(good, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 300)
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    rows = odd_vectors(800, 40, 3, 0.1)
    got = hard_negatives.mine(quantised(spark.createDataFrame(rows, VECTORS)), F.col("id") % 100 == 0)
    want = brute_negatives(rows)
    assert len(want) > 200 and sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.mine(quantised(spark.createDataFrame([], VECTORS)), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 40, 64, 200])
def test_intervals_hold_all_scores(size):
    """Every score lies within its interval, whatever the vectors look like, and lists are those of all scores."""
    rng = np.random.default_rng(size)
    x = np.floor(256 * np.concatenate([rng.normal(size=(500, size)) / np.sqrt(size), rng.normal(3, 0.1, (100, size)), np.zeros((3, size)), rng.integers(-1000, 1000, (50, size))])).astype(np.int64)
    shard = hard_negatives.Shard(np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), np.int64), x)
    low, high = shard.codes.bounds(x)
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    every = np.ones(len(x), bool)
    for i in range(500):
        ((_, places, got),) = shard.positives(x[i], every, low[i], high[i], 5)
        best = np.lexsort((np.arange(len(x)), -scores[i]))[:5]
        assert places.tolist() == best.tolist() and got.tolist() == scores[i][best].tolist()


def test_intervals_leave_few_to_be_scored():
    x = np.floor(256 * np.random.default_rng(1).normal(size=(4000, 64)) / 8).astype(np.int64)
    shard, every = hard_negatives.Shard(np.arange(4000), np.zeros(4000, np.int64), np.ones(4000, np.int64), x), np.ones(4000, bool)
    low, high = shard.codes.bounds(x[:100])
    for i in range(100):
        shard.positives(x[i], every, low[i], high[i], 5)
    assert shard.scored < 0.45 * 100 * 4000


def test_rotation_keeps_products():
    x = np.random.default_rng(0).normal(size=(20, 70))
    assert np.allclose(hard_negatives.rotated(x) @ hard_negatives.rotated(x).T, x @ x.T)


def brute_components(rows, least=0.9):
    vectors = [np.array(v) / np.abs(v).max() if usable(v) and any(v) else None for _, v, *_ in rows]
    ids, top, links = [r[0] for r in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    low = [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted([(ids[i], links[i], low[i], ids[i] == low[i]) for i in range(len(rows))], key=str)


@pytest.mark.parametrize("spread", [0.05, 0.09])
def test_embedding_dedup(spark, monkeypatch, spread):
    """All links at once, over lists and blocks that are small: copies, near ones, chains of them, and rows that link with nothing."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "LIST", 64)
    rows = odd_vectors(700, 16, 5, spread)
    rows += [(9600, [x * 1e300 for x in rows[5][1]], 1, "x"), (9601, [x * 1e-300 for x in rows[5][1]], 1, "x"), (None, None, 1, "x")]
    got = embedding_dedup.near(spark.createDataFrame(rows, VECTORS).repartition(3))
    want = brute_components(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(n for _, n, *_ in want) > 2000 and len({c for *_, c, _ in want}) > 20
    assert embedding_dedup.near(spark.createDataFrame([], VECTORS)).count() == 0


def test_probes_and_lookups_lose_no_pair():
    """Pairs that are close enough pass both the choice of lists and the table lookup; most others don't pass the lookup."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 64)) * 0.42
    x /= np.sqrt((x * x).sum(1))[:, None]
    model, limit = embedding_dedup.Model.fit(x[rng.permutation(3000)[:1000]], 16_000), float(np.sqrt(0.2))
    home, far, codes, error = model.encode(x)
    radius = np.array([far[home == k].max() if (home == k).any() else -1.0 for k in range(len(model.centres))])
    probes = model.probes(x, home, radius, limit)
    link = x @ x.T >= 0.9
    assert 300 < (link.sum() - 3000) / 2 < 1500 and len(model.centres) == 15
    assert probes[np.arange(3000)[:, None], home[None, :]][link].all()
    passed = 0
    for k in range(len(model.centres)):
        inside = np.flatnonzero(home == k)
        hopeful = model.hopeful(x, k, codes[inside], error[inside], limit)
        assert hopeful.T[link[:, inside]].all()
        passed += hopeful.sum()
    assert passed < 0.1 * 3000**2


def test_spanning_edges_join_what_links_join():
    rng = np.random.default_rng(9)
    for _ in range(30):
        link = rng.random((12, 15)) < 0.08
        rows, columns = np.arange(12) * 7 + 3, 200 - np.arange(15)
        edges = embedding_dedup.spanning(link, rows, columns)
        assert len(edges) <= 27

        def groups(pairs):
            top = {int(i): int(i) for i in [*rows, *columns]}
            for a, b in [*pairs, *pairs] * 14:
                top[a] = top[b] = min(top[a], top[b])
            return top

        pairs = [(int(rows[i]), int(columns[j])) for i, j in np.argwhere(link)]
        assert groups(pairs) == groups(edges)


def brute_variants(docs, every=199, least_length=6, least_count=5, ratio=5):
    n = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            if k is not None and (h := zlib.crc32(f"{k}:{run}".encode())) % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near, masks = {w: set() for w in words}, {}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            masks.setdefault((i, less), []).append(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in masks.values():
        for a in group:
            near[a] |= set(group) - {a}
    form = {w: min(near[w], key=lambda u: (-words[u], u), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= ratio * words[w] else None for w, f in form.items()}
    out = set()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    """Words of few letters that are alike, runs of one letter, very long words, null and repeated rows."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(1, 9)))
    common = ["aabbcc", "Aabbccc", "aabbccé", "aabbccéé"]
    docs = [(k, " ".join([*(word() for _ in range(6000)), *[w for i, w in enumerate(common) for _ in range(6**i)], "aaaaaaaa Aaaaaaa aaaaaaaaa", "ÀÉÎÕÜß-ÀÉÎÕÜ×x÷"])) for k in range(8)]
    docs += [(None, "x" * 3000 + " " + "x" * 2999 + " abcabc y" + "x" * 2999)] * 6 + [(9, None), (10, ""), (11, "1 2 ,")]
    table = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, word string").repartition(4)
    got = {tuple(r) for r in spelling.variants(spelling.word_counts(table, 199, 6, 5)).collect()}
    want = brute_variants(docs)
    assert got == want and sum(r[1] is not None for r in want) >= 3 and any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling.variants(spelling.word_counts(table.limit(0), 199, 6, 5)).count() == 0


def test_short_words_have_neighbours(spark):
    """In general words may have any length: one letter, or its like beside nothing."""
    words = {"a": 3, "b": 100, "ab": 1, "ba": 2, "abc": 9, "c": 1, "abcd": 5, "xyz": 1}
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {"a": ("b", "b", 4), "b": (None, "b", 4), "ab": ("b", "b", 3), "ba": ("b", "b", 2), "abc": (None, "abc", 2), "c": ("b", "b", 2), "abcd": (None, "abcd", 1), "xyz": (None, "xyz", 0)}


def test_spelling_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()} == brute_variants(docs)


@pytest.mark.parametrize("name", ["op2_exact_topk", "op11_hard_negatives", "op12_embedding_dedup"])
def test_vector_queries_against_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())


def test_blocks_of_vectors_are_not_sent_to_each_other(spark, monkeypatch):
    """What is shuffled for near duplicates goes with the vectors and not with their square, though vectors without clusters probe most lists; and links don't depend on the runs that are broadcast."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "LIST", 64)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(rng.normal(size=(1500, 32)))]
    rows += [(2000 + i, [x + 0.01 for x in rows[i][1]], 1, "x") for i in range(0, 1500, 10)]
    df, before = spark.createDataFrame(rows, VECTORS), total()
    # so small a table would be broadcast by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, embedding_dedup.near(df).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 2.9 MB; 6.5 MB when each vector was sent to the blocks of the lists it probes
    assert total() - before < 5_000_000
    assert got == sorted(brute_components(rows))
    monkeypatch.setattr(embedding_dedup, "CHUNK_BYTES", 30_000)
    runs, kept = [], embedding_dedup.found
    monkeypatch.setattr(embedding_dedup, "found", lambda blocks, run, *rest: (runs.append(len(run)), kept(blocks, run, *rest))[1])
    assert sorted(map(tuple, embedding_dedup.near(df).collect())) == got and len(runs) > 10
