"""Quality classifier by co-training of two views.

The text view sees hashed byte trigrams of the whole text; the metadata view sees source, language,
length and layout. Both are logistic models, fitted on a bounded sample of labelled documents. In each
round each view is calibrated on labelled documents set aside and scores all unlabelled documents, in
tasks; those that it is most sure of, ``HANDED`` of each class at most, get its label and join the other
view's training set. In the end the calibrated log-odds, less the prior that both contain, add up to the
score of every document.

``LABELLED`` bounds the labelled sample (ids by hash order), ``HANDED`` a view's exchange in a round; the
features of those documents come to the driver. A round and the scoring read every document once each and
shuffle nothing but labels.

Null text counts as empty; null source, language or length are values of their own; a label for no
document is ignored; documents with contradicting labels count for each; without labels of both classes
every document is kept with a null score; repeated rows are scored alike, and texts alike are handed over
once; ties in sureness go by the text's hash; columns beside doc_id, text, lang, source and n_chars are
ignored, whatever their names (``kept`` passes them through); an empty table gives no rows. A very long
text is read in blocks, so it takes little more memory than itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import sized, stash
from tracewright.llm.shingles import batches_of

LABELLED, HANDED = 5000, 150
#: Hashed features of the text view: trigrams of bytes, trigrams of byte classes, steps of repetition; of the metadata view: names.
BYTE_DIMS, CLASS_DIMS, STEP_DIMS, META_DIMS = 1024, 256, 32, 256
TEXT_DIMS = BYTE_DIMS + CLASS_DIMS + STEP_DIMS
#: Letters and digits by class; other ASCII characters are classes of their own.
CLASS_OF = np.arange(256, dtype=np.uint32)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58], CLASS_OF[128:] = 1, 2, 3, 4
DOCS_AT_ONCE, BLOCK = 256, 1_000_000


def trigram_counts(b: np.ndarray, doc: np.ndarray, docs: int, bits: int) -> np.ndarray:
    """Hashed trigrams of each document's bytes, a row per document; doc: whose each byte is."""
    h = ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)).astype(np.int64)
    return np.bincount(((doc[:-2] << bits) + h)[doc[:-2] == doc[2:]], minlength=docs << bits).reshape(docs, 1 << bits)


def text_view(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, and how concentrated these are, a row per text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.zeros((len(texts), TEXT_DIMS), np.float32)
    i = 0
    while i < len(texts):
        # as many texts as make a block, or one, which is then read a block at a time
        j = max(i + 1, min(i + DOCS_AT_ONCE, len(texts), int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1))
        for bits, at in ((10, 0), (8, BYTE_DIMS)):
            counts = np.zeros((j - i, 1 << bits), np.int64)
            for a in range(int(offsets[i]), int(offsets[j]), BLOCK):
                z = min(a + BLOCK + 2, int(offsets[j]))
                doc = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1])) if j - i > 1 else np.zeros(z - a, np.int64)
                counts += trigram_counts((data[a:z] if not at else CLASS_OF[data[a:z]]).astype(np.uint32), doc, j - i, bits)
            shares = counts / np.maximum(1, counts.sum(1, keepdims=True))
            out[i:j, at : at + (1 << bits)] = np.sqrt(shares)
            if not at:
                step = np.clip(-4 * np.log2(np.maximum((shares**2).sum(1), 1e-9)), 0, STEP_DIMS - 1).astype(np.int64)
                out[np.arange(i, j), BYTE_DIMS + CLASS_DIMS + step] = 1
        i = j
    return out


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed indicators of source, language, length and layout, a row per document."""
    import zlib

    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False).astype(float)
    chars = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    blanks = pc.count_substring(texts, " ").to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((batch.num_rows, META_DIMS), np.float32)
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    step = lambda x, k: int(k * np.log2(x + 1))
    for i in range(batch.num_rows):
        known = "none" if np.isnan(chars[i]) else step(max(chars[i], 0), 2)
        names = (f"source={source[i]}", f"lang={lang[i]}", f"chars={known}", f"lines={step(lines[i], 2)}", f"line={step(size[i] / lines[i], 2)}", f"word={step(size[i] / (blanks[i] + lines[i]), 6)}")
        for name in names:
            out[i, zlib.crc32(name.encode()) % META_DIMS] += 1
    return out


class Logistic:
    """A logistic model, fitted by Adam on all rows at once, with the classes weighted alike."""

    def __init__(self, dims: int):
        self.mean, self.w, self.b = np.zeros(dims, np.float32), np.zeros(dims, np.float32), 0.0
        self.a, self.c = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.05, l2: float = 1e-3) -> Logistic:
        z = x.astype(np.float32)
        self.mean = z.mean(0)
        self.scale = 1 / (z.std(0) + 0.01)
        z -= self.mean
        z *= self.scale
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for k in range(1, rounds + 1):
            g = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) * weight
            gw, gb = z.T @ g + l2 * w, float(g.sum())
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
            b -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-6)
        self.w, self.b = (w * self.scale).astype(np.float32), b
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.w + (self.b - float(self.mean @ self.w))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling: log-odds a * margin + c by Newton's method, with his smoothed targets."""
        s = self.margin(x).astype(float)
        pos, neg = (y > 0).sum(), (y <= 0).sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, c = 1.0, 0.0

        def loss(a: float, c: float) -> float:
            u = a * s + c
            return float((np.logaddexp(0, u) - t * u).sum() + 5e-4 * (a - 1) ** 2)

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            q = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - t) * s).sum() + 1e-3 * (a - 1), (p - t).sum()])
            h = np.array([[(q * s * s).sum() + 1e-3, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-6]])
            d, step = np.linalg.solve(h, g), 1.0
            while step > 1e-4 and loss(a - step * d[0], c - step * d[1]) > loss(a, c):
                step /= 2
            a, c = a - step * d[0], c - step * d[1]
            if step * np.abs(d).max() < 1e-6:
                break
        self.a, self.c = a, c

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.margin(x) + self.c, -12, 12)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_x, meta_x: both views of each row, as float16 bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1, 4_000_000):
            pair = [[row.tobytes() for row in x.astype(np.float16)] for x in (text_view(b.column("text")), meta_view(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.binary()) for x in pair]], ["doc_id", "text_x", "meta_x"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_x binary, meta_x binary")


class CoTrained:
    """Two calibrated views and the prior log-odds of the labelled sample."""

    def __init__(self, views: list[Logistic], prior: float):
        self.views, self.prior = views, prior

    def odds(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of either view and of both together."""
        own = [v.odds(x) for v, x in zip(self.views, xs)]
        return [*own, own[0] + own[1] - self.prior]


#: Picks of a round, for each view: features of both views and labels of the documents that it hands to the other one.
Picks = list[tuple[list[np.ndarray], np.ndarray]]


def co_train(x: list[np.ndarray], y: np.ndarray, surest: Callable[[list[Logistic]], Picks], rounds: int = 3) -> CoTrained:
    """Fits both views on labelled rows (every fifth of each class is kept for calibration) and on what ``surest`` gives, round by round."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        held[own[min(4, len(own) - 1) :: 5] if len(own) > 1 else own[:0]] = True
    train = [[v[~held]] for v in x]
    labels = [[y[~held].astype(np.float32)] for _ in x]
    for k in range(rounds + 1):
        views = [Logistic(t[0].shape[1]).fit(np.concatenate(t), np.concatenate(v)) for t, v in zip(train, labels)]
        for view, v in zip(views, x):
            view.calibrate(v[held], y[held])
        if k < rounds:
            for i, (both, picked) in enumerate(surest(views)):
                if len(picked):
                    train[1 - i].append(both[1 - i])
                    labels[1 - i].append(picked.astype(np.float32))
    share_good = (y[held].sum() + 1) / (held.sum() + 2)
    return CoTrained(views, float(np.log(share_good / (1 - share_good))))


class Exchange:
    """Each call scores all unlabelled documents with both views and returns each view's surest, none handed over by it before."""

    def __init__(self, docs: DataFrame, most: int = HANDED, sure: float = 3.0):
        self.docs = docs.select(F.xxhash64("text").alias("of"), "text", "lang", "source", "n_chars")
        self.most, self.sure = most, sure
        self.handed: list[set[int]] = [set(), set()]

    def __call__(self, views: list[Logistic]) -> Picks:
        most, sure, handed = self.most, self.sure, self.handed

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # of each view and class, the lowest so many (-sureness, hash) with their features
            best: dict[tuple[int, int], dict[int, tuple]] = {(i, c): {} for i in (0, 1) for c in (0, 1)}
            for b in batches_of(batches, 1, 4_000_000):
                of, xs = b.column(0).to_pylist(), [text_view(b.column("text")).astype(np.float16), meta_view(b).astype(np.float16)]
                for i, view in enumerate(views):
                    odds = view.odds(xs[i])
                    for c, s in ((0, -odds), (1, odds)):
                        own = best[i, c]
                        least = min((v[0] for v in own.values()), default=sure) if len(own) >= most else sure
                        for k in np.flatnonzero((s > sure) & (s >= least)).tolist():
                            if of[k] not in handed[i] and (of[k] not in own or own[of[k]][0] < s[k]):
                                own[of[k]] = (float(s[k]), xs[0][k].tobytes(), xs[1][k].tobytes())
                        if len(own) > most:
                            best[i, c] = dict(sorted(own.items(), key=lambda kv: (-kv[1][0], kv[0]))[:most])
            rows = [(i, c, of, *v) for (i, c), own in best.items() for of, v in own.items()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["view", "label", "of", "s", "text_x", "meta_x"])

        found = stash(self.docs.mapInArrow(work, "view int, label int, of long, s double, text_x binary, meta_x binary"), "surest")
        # a text may come with several rows of metadata: the surest counts
        once = found.groupBy("view", "label", "of").agg(F.max("s").alias("s"))
        out: Picks = []
        for i in (0, 1):
            tops = [once.where(f"view = {i} and label = {c}").orderBy(F.col("s").desc(), "of").limit(most) for c in (0, 1)]
            top = tops[0].unionByName(tops[1])
            rows = top.join(found, ["view", "label", "of", "s"]).orderBy("label", F.col("s").desc(), "of", "meta_x").collect()
            rows = list({(r["label"], r["of"]): r for r in reversed(rows)}.values())[::-1]
            handed[i].update(r["of"] for r in rows)
            xs = [np.stack([np.frombuffer(r[x], np.float16) for r in rows]) if rows else np.zeros((0, 1), np.float16) for x in ("text_x", "meta_x")]
            out.append((xs, np.array([r["label"] for r in rows])))
        return out


def by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most so many of the ids, by hash order."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, handed: int = HANDED, rounds: int = 3) -> CoTrained | None:
    """The model for docs (doc_id, text, lang, source, n_chars) and labels (doc_id, label); None without labels of both classes."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    ids = docs.select("doc_id").where("doc_id is not null")
    # the sample is bounded by a parameter, so that it can be broadcast
    chosen = by_hash(marked.join(ids.distinct(), "doc_id", "left_semi"), labelled).select(F.col("doc_id").alias("chosen"), "label")
    picked = docs.join(F.broadcast(chosen.select("chosen").distinct()), F.col("doc_id") == F.col("chosen"), "left_semi")
    found = {r[0]: (r[1], r[2]) for r in features(picked).toLocalIterator()}
    rows = sorted((r["chosen"], r["label"]) for r in chosen.collect() if r["chosen"] in found)
    y = np.array([v for _, v in rows], np.int64)
    if not (y == 0).any() or not (y == 1).any() or len(y) < 10:
        return None
    x = [np.stack([np.frombuffer(found[d][i], np.float16) for d, _ in rows]) for i in (0, 1)]
    del found
    known = stash(marked.select(F.col("doc_id").alias("known")).distinct(), "labelled")
    unlabelled = docs.join(sized(known), F.col("doc_id") == F.col("known"), "left_anti")
    return co_train(x, y, Exchange(unlabelled, handed), rounds)


def score(docs: DataFrame, model: CoTrained | None, limit: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every row of docs (doc_id, text, lang, source, n_chars)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1, 4_000_000):
            if model is None:
                cols = [pa.nulls(b.num_rows, pa.float64())] * 3 + [pa.array(np.ones(b.num_rows, bool))]
            else:
                p = [1 / (1 + np.exp(-o.astype(float))) for o in model.odds([text_view(b.column("text")), meta_view(b)])]
                cols = [pa.array(x) for x in (*p, p[2] >= limit)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(work, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")


def kept(docs: DataFrame, model: CoTrained | None, limit: float = 0.5) -> DataFrame:
    """The rows of docs that the model keeps, whole, in one pass."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, at, 4_000_000):
            good = model.odds([text_view(b.column("text")), meta_view(b)])[2] >= np.log(limit / (1 - limit))
            yield b.filter(pa.array(good))

    return docs if model is None else docs.mapInArrow(work, docs.schema)
