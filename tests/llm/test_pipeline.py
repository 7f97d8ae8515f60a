"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import brute_join
from tracewright.llm import classifier, mixing, packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad documents, exact and near copies, and a passage that many documents share."""
    rng, rows = np.random.default_rng(11), []
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 7)))
    line = lambda n=9: " ".join(word() for _ in range(n))
    passage = "\n".join(line() for _ in range(9))
    for i in range(240):
        text = "\n".join(line() for _ in range(8))
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 5 == 1:
            text = f"{text}\n{passage}\n{line()}"
        elif i % 5 == 2 and i > 20:
            text = rows[i - 20][1] if i % 2 else rows[i - 20][1].replace(" ", "  ", 1) + " " + word()
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text)))
    rows += [(900, None, "en", "s1", None), (901, "", None, None, 0)]
    sf = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 240, 2)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    return sf


def brute_lines(rows):
    """Units (chunks, windows of fifty words, long lines) that stand elsewhere before."""
    first, out = {}, {}
    for k in sorted(rows):
        lines = rows[k].split("\n")
        n = len(lines)
        v = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) for x in lines]
        words = [len(WORD.findall(x)) for x in lines]
        marks = [i > 0 and (v[i - 1] * 31 + v[i]) % 1021 < 510 for i in range(n)]
        units, start = {(2, i, i + 1) for i in range(n) if words[i] >= 50}, 0
        for i in range(n):
            if i == n - 1 or marks[i] and not marks[i - 1]:
                units |= {(0, start, i + 1)} if i > start else set()
                start = i + 1
            units |= {(3, i, z) for z in [next((z for z in range(i + 1, n + 1) if sum(words[i:z]) >= 50), 0)] if z > i + 1}
            units |= {(3, a, i + 1) for a in [next((a for a in range(i, -1, -1) if sum(words[a : i + 1]) >= 50), i)] if a < i}
        gone = set()
        for sort, a, z in sorted(units, key=lambda u: u[1]):
            text = "\n".join(lines[a:z])
            if WORD.search(text):
                of, at = first.setdefault((sort, text), (k, a))
                gone.update(range(a, z) if of != k or a >= at + z - a else ())
        if len(gone) < n:
            out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def brute_mix(rows):
    """Copies of each document (doc_id, source, size)."""
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(size.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        free -= over or free
    out = {}
    for s in order:
        own = [(k, n, (len(f"{n + 1:b}") + 3) / 4) for k, source, n in rows if source == s]
        full, scale = set(), 0.0
        while len(full) < len(own):
            free = [(w, n) for k, n, w in own if k not in full]
            scale = (target[s] - 2 * sum(n for k, n, _ in own if k in full)) / max(1e-9, sum(w * n for w, n in free))
            over = {k for k, _, w in own if k not in full and scale * w >= 2}
            full |= over
            if not over:
                break
        ranked, lacks = [], target[s]
        for k, n, w in own:
            f = 0.0 if not size[s] else 2.0 if k in full else scale * w
            whole, p = int(f), f - int(f)
            out[k] = whole
            lacks -= whole * n
            u = (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if p > 0:
                ranked.append((u / (1 - u) / (p / (1 - p)), k, n))
        so_far = 0
        for _, k, n in sorted(ranked):
            out[k] += so_far + n / 2 <= lacks
            so_far += n
    return out


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], corpus).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert [t.columns for t in tables[:-1]] == [columns] * 5
    raw, good, lean, single, mixed = ([tuple(r) for r in t.collect()] for t in tables[:-1])

    model = classifier.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert {r[0] for r in good} == {r.doc_id for r in classifier.score(docs, model).collect() if r.kept}
    bad = {r[0] for r in raw if r[0] < 240 and r[0] % 5 == 0}
    assert len(bad & {r[0] for r in good}) <= 1 and len({r[0] for r in raw if r[0] < 240} - bad - {r[0] for r in good}) <= 4

    want = brute_lines({r[0]: r[1] for r in good if r[1] is not None})
    assert {r[0]: r[1] for r in lean if r[1] is not None} == want
    assert all(r[4] == len(r[1]) for r in lean if r[1] is not None)

    groups = brute_join({r[0]: r[1] or "" for r in lean})
    assert sorted(r[0] for r in single) == sorted(k for k, (_, c) in groups.items() if k == c)

    copies = brute_mix([(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in single])
    assert Counter(r[0] for r in mixed) == Counter({k: int(n) for k, n in copies.items() if n})

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    length, room = Counter(), defaultdict(int)
    placed = tables[-1].collect()
    bound = packing.lower_bound(np.bincount([r.length for r in placed], minlength=4097), 4096)
    for r in placed:
        length[r.doc_id] += r.length
        room[r.sequence_id] += r.length
    times = Counter(r[0] for r in mixed)
    assert length == Counter({r[0]: times[r[0]] * (1 + len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in mixed})
    assert max(room.values()) <= 4096 and bound <= len(room) <= bound + 1
    assert corpus_pipeline.run(spark, corpus).count() == tables[-1].count()


def test_null_and_repeated_ids(spark):
    """Rows are kept by what they hold: neither a null id nor one that others have makes a clean document a copy."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefgh"}
    rows = [(1, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["c"]), (2, text["d"]), (2, text["e"]), (2, text["e"]), (3, text["f"]), (5, text["g"]), (4, text["g"] + " more")]
    rows += [(6, None), (6, None), (6, ""), (7, " "), (None, ""), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", f"s{i % 2}", None) for i, (k, t) in enumerate(rows)], DOCS).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect())
    want = [(1, text["a"]), (None, text["b"]), (None, text["c"]), (2, text["d"]), (2, text["e"]), (3, text["f"]), (4, text["g"] + " more")]
    assert got == Counter([*want, (6, None), (6, ""), (7, " "), (None, ""), (None, "")])


def test_mixing_copies_each_row_by_its_own_share(spark):
    rows = [(k, " ".join(f"w{i}" for _ in range(n)), "en", s, None) for i, (k, n, s) in enumerate([(None, 5, "a"), (None, 9, "b"), (None, 7, "c"), (1, 8, "a"), (1, 6, "b"), (1, 20, "c"), (2, 11, "a")])]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r.doc_id, r.source, r["size"])] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in corpus_pipeline.source_mixing(spark, docs, "").collect())
    assert got == +want


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(k, f"{'w ' * k}x", "en", "s", None, 10 * k, 20 * k, 30 * k) for k in range(1, 9)]
    docs = spark.createDataFrame(rows, DOCS + ", copy int, copies int, nth int")
    got = corpus_pipeline.source_mixing(spark, docs, "")
    assert got.columns == docs.columns and all((r.copy, r.copies, r.nth) == (10 * r.doc_id, 20 * r.doc_id, 30 * r.doc_id) for r in got.collect())


def test_stages_of_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Columns that stages might use inside come out as they went in, and next to the text they belong to."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = ["__row", "__gone", "row_number", "row", "group", "of", "place", "gone", "copies"]
    docs = docs.select("*", *[F.concat("doc_id", F.lit(f" {n}")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{r.doc_id} {n}" for r in rows for n in names), name


def test_workers_keep_little_between_stages():
    """What shingles of one stage needed is gone when another begins, and large groups of pandas tidy up as well."""
    import pandas as pd
    import pyarrow as pa

    from tracewright.llm import shingles

    df = pd.DataFrame({"n": [1]})
    for done in (shingles.give_back, lambda: shingles.tidied(lambda x: x)(df), lambda: list(shingles.batches_of(iter(())))):
        shingles.shingle_sets(pa.array(["one two three four five six"]))
        assert shingles._powers
        done()
        assert not shingles._powers
