"""Secret scan: three patterns, and a linear-chain conditional random field that finds more.

The field tags the words of a whole text as begin, inside or outside of a secret. A word's score adds
weights of its shape, of the classes of its neighbours (two before, one after) and of two features of
the file; the best tagging is found by Viterbi. It is trained here, by maximum likelihood, on a bounded
sample of short windows: around the secrets that the patterns find, and elsewhere, half of the latter around
words that aren't plain. All secrets and all texts are candidates; the ``SAMPLE`` windows of lowest hash of
each sort are taken. A window's features come from its whole text, by the code that decoding uses. So that the
field learns more than the patterns' own rule, secrets are taught once more with their key words hidden, and as
made-up ones of other alphabets (``variants``); what random-looking words the corpus itself has without being secrets,
it learns from the windows elsewhere, but for those that a first field takes for secrets after all.

Decoding is exact, but words whose outside score leads by more than any change of transitions can make up
for are outside in every best tagging, so Viterbi only runs over the stretches between them.

Null text counts as empty; without any pattern match in the corpus nothing can be learned and nothing is
added; repeated rows are scanned each for itself, and alike windows count once in the sample; windows of
the same hash are taken in the order of their words; null ids and extra columns are harmless (doc_id and
text are read); an empty table gives no rows. A very long text is held by one task, with about ten bytes
for each word and what its distinct words take; time follows its length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracewright.llm.common import stash
from tracewright.llm.shingles import batches_of

KINDS = ("assign", "access", "hex")
ADDED = "crf"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a text must have for a pattern to be looked for (a superset of what matches, for Arrow's engine).
HINTS = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

#: Windows of each sort to train on at most, and words on either side of a window's middle.
SAMPLE, REACH = 4000, 8
OUT, BEGIN, INSIDE = 0, 1, 2

KEY_WORD = r"(?i)(passw|secret|token|key|auth|cred|bearer)"
PLAIN_WORD = r"^[\p{L}'’-]{1,24}[.,;:!?)\"#*$%&|]*$"
CLASSES = ("none", "plain", "key", "assign", "key_assign", "mark", "number", "mixed", "long", "other")
CLASS = {c: i for i, c in enumerate(CLASSES)}
N_SHAPES, N_FILE = 96, 6
STRIP = "\"'`“”‘’#*$%&|<>()[]{},;:.!?=\\"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """start, kind, end, start of the secret itself; by start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def hinted(texts: pa.Array) -> np.ndarray:
    """Which texts can have a base span."""
    marks = [pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in HINTS.values()]
    return np.logical_or.reduce(marks)


def word_class(word: str) -> int:
    """Class of a word that isn't plain, as its neighbours see it."""
    key = re.search(KEY_WORD, word) is not None
    ends = word[-1] in "=:" or word[-2:] in ('="', "='", ':"')
    if key:
        return CLASS["key_assign" if ends or "=" in word or ":" in word else "key"]
    if ends:
        return CLASS["assign"]
    core = word.strip(STRIP)
    if not core:
        return CLASS["mark"]
    if re.fullmatch(r"[0-9.,:/()+-]+", core):
        return CLASS["number"]
    if any(c.isdigit() for c in core) and any(c.isalpha() for c in core):
        return CLASS["long" if len(core) >= 16 else "mixed"]
    return CLASS["long" if len(core) >= 25 else "other"]


def shapes(word: str) -> list[int]:
    """Indices of a word's shape features, all below N_SHAPES; the first is there for every word."""
    core = word.strip(STRIP)
    n, out = len(core), [0]
    out.append(1 + min(7, int(math.log2(n + 1))))
    digits, upper, lower = sum(c.isdigit() for c in core), sum(c.isupper() for c in core), sum(c.islower() for c in core)
    out.append(10 + (digits * 4 // n if n else 5))
    out.append(16 + (digits > 0) * 4 + (upper > 0) * 2 + (lower > 0))
    if n:
        counts = np.array(list(Counter(core).values()))
        bits = float(-(counts / n * np.log2(counts / n)).sum())
        out.append(24 + min(9, int(bits * 2)))
        turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(core, core[1:]))
        out.append(34 + min(7, turns * 16 // n))
        out.append(42 + (2 if re.fullmatch(r"[0-9a-fA-F]+", core) else 1 if re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) else 0))
        out.append(45 + min(5, sum(not c.isalnum() for c in core)))
        if n >= 16 and digits and turns * 5 >= n:
            out.append(52)
    out.append(53 + (word[:1] in "\"'`") * 2 + (word[-1:] in "\"'`"))
    out.append(58 + word_class(word))
    return out


def file_feature(words: int, classes: np.ndarray) -> int:
    """One of N_FILE: how much of a text is anything but plain words, and whether it has assignments."""
    odd = int((classes >= CLASS["mark"]).sum()) / max(1, words)
    has = bool(((classes == CLASS["assign"]) | (classes == CLASS["key_assign"])).any())
    return (0 if odd < 0.02 else 1 if odd < 0.2 else 2) * 2 + has


def is_plain(words: pa.Array) -> np.ndarray:
    """Which words are plain: those have no shape but the one of all words."""
    match = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    return match(PLAIN_WORD) & ~match(KEY_WORD)


class Words:
    """The words of some texts as numbers of distinct words, with the classes of the latter."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = pc.dictionary_encode(lists.flatten())
        self.distinct, self.at = flat.dictionary, np.asarray(flat.indices)
        self.ends = np.asarray(lists.offsets).astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
        # the splitter gives an empty word at either end of a text that begins or ends with space
        empty = pc.equal(self.distinct, "").to_numpy(zero_copy_only=False)
        if empty.any():
            keep = ~empty[self.at]
            self.ends = np.concatenate([[0], np.cumsum(keep)])[self.ends]
            self.at = self.at[keep]
        self.odd = np.flatnonzero(~is_plain(self.distinct) & ~empty)
        self.odd_words = self.distinct.take(pa.array(self.odd)).to_pylist()
        self.classes = np.full(len(self.distinct), CLASS["plain"], np.int8)
        self.classes[self.odd] = [word_class(w) for w in self.odd_words]

    def neighbours(self) -> list[np.ndarray]:
        """Class of the word two before, one before and one after each word; none beyond the text."""
        own = self.classes[self.at]
        n = np.diff(self.ends)
        doc = np.repeat(np.arange(len(n)), n)
        out = []
        for shift in (2, 1, -1):
            c = np.zeros(len(own), np.int8)
            if shift > 0 and len(own) > shift:
                same = doc[shift:] == doc[:-shift]
                c[shift:][same] = own[:-shift][same]
            elif shift < 0 and len(own) > 1:
                same = doc[1:] == doc[:-1]
                c[:-1][same] = own[1:][same]
            out.append(c)
        return out

    def files(self) -> np.ndarray:
        own = self.classes[self.at]
        return np.array([file_feature(b - a, own[a:b]) for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist())], np.int8)


def tags_of(text: str, spans: list[tuple[int, int, int, int]]) -> list[int]:
    """Tags of a text's words: where secrets themselves begin and go on."""
    secrets = sorted({(s[3], s[2]) for s in spans})
    tags, k = [], 0
    for m in WORD.finditer(text):
        while k < len(secrets) and secrets[k][1] <= m.start():
            k += 1
        hit = k < len(secrets) and secrets[k][0] < m.end()
        tags.append((BEGIN if secrets[k][0] >= m.start() else INSIDE) if hit else OUT)
    return tags


def numbers(texts: pa.Array) -> np.ndarray:
    """A 61-bit hash of each text."""
    return np.array([int.from_bytes(hashlib.blake2b(x.as_buffer(), digest_size=8).digest(), "little") >> 3 for x in texts], np.int64)


def rank_of(number: int, place: int) -> int:
    """Place in the random order of windows of the one around a text's word."""
    return (number ^ (place * 0x9E3779B97F4A7C15)) % (1 << 61)


class Lowest:
    """The limit below which an item is among the lowest so many of those seen."""

    def __init__(self, most: int):
        self.most, self.ranks = most, np.zeros(0, np.int64)

    def limit(self) -> int:
        return int(self.ranks[-1]) if len(self.ranks) == self.most else 1 << 62

    def add(self, ranks: list[int]) -> None:
        self.ranks = np.unique(np.concatenate([self.ranks, np.array(ranks, np.int64)]))[: self.most]


def windows(docs: DataFrame, sample: int, share: float = 1.0) -> DataFrame:
    """rank, positive, words, near, tags, file: the sample of windows, fixed by hashes of the texts.

    ``near``: classes of the word two before, before and after each word. For windows elsewhere only
    texts whose hash is in the lowest ``share`` of all are looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = {True: Lowest(sample), False: Lowest(sample)}
        for b in batches_of(batches, 0, 8_000_000):
            texts = b.column(0).cast(pa.large_string()).fill_null("")
            hint, number = hinted(texts), numbers(texts)
            # a rank differs from the text's number by what the place adds, so the share is of another hash
            shared = number * 0x5851F42D4C957F2D % (1 << 61) <= share * (1 << 61)
            looked = np.flatnonzero(hint | shared)
            some = texts.take(pa.array(looked))
            if not len(some):
                continue
            words = Words(some)
            own, near, files = words.classes[words.at], np.stack(words.neighbours(), 1), words.files()
            rows = []
            for i, k in enumerate(looked.tolist()):
                a, z = int(words.ends[i]), int(words.ends[i + 1])
                if a == z:
                    continue
                tags = tags_of(some[i].as_py(), base_spans(some[i].as_py())) if hint[k] else [OUT] * (z - a)
                elsewhere = set()
                if shared[k]:
                    odd = np.flatnonzero(own[a:z] >= CLASS["mark"])
                    elsewhere = {int(number[k]) % (z - a)} | ({int(odd[int(number[k]) % len(odd)])} if len(odd) else set())
                for place in sorted({j for j, t in enumerate(tags) if t == BEGIN} | elsewhere):
                    low, high = max(0, place - REACH), min(z - a, place + REACH + 1)
                    rank, positive = rank_of(int(number[k]), place), any(tags[low:high])
                    if rank <= lowest[positive].limit():
                        rows.append((rank, positive, a + low, a + high, tags[low:high], int(files[i])))
            for sort, kept in lowest.items():
                kept.add([r[0] for r in rows if r[1] == sort])
            rows = [r for r in rows if r[0] <= lowest[r[1]].limit()]
            names = ["rank", "positive", "words", "near", "tags", "file"]
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
            rows = [(rank, positive, words.distinct.take(pa.array(words.at[a:z])).to_pylist(), near[a:z].reshape(-1).tolist(), tags, file) for rank, positive, a, z, tags, file in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    found = stash(docs.select("text").mapInArrow(work, "rank long, positive boolean, words array<string>, near array<int>, tags array<int>, file int"), "windows")
    least = lambda flag: found.where(f"positive = {flag}").distinct().orderBy("rank", "words", "near", "tags", "file").limit(sample)
    return least("true").unionByName(least("false"))


#: What hides a key word, and the alphabets and lengths of made-up secrets.
HIDDEN = re.compile(r"(?i)[a-z_-]*(?:passw|secret|token|key|auth|cred|bearer)[a-z_-]*")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "_-", UPPER + DIGITS, LOWER + DIGITS, DIGITS + "ABCDEF")
SHORTEST, LONGEST = 20, 48


def variants(window: dict) -> list[dict]:
    """The window of a secret with its key words hidden, once with the secret itself and twice with a made-up one.

    A made-up secret has letters and digits of one of ALPHABETS, fixed by the window's rank. The marks of an
    assignment before a secret stay, or are hidden as well, or a key word takes their place or that of the word before.
    """
    out = []
    for made_up in range(3):
        rng = random.Random(window["rank"] * 3 + made_up)
        mark = rng.choice((None, "is", "key"))
        words, near, tags = list(window["words"]), list(window["near"]), list(window["tags"])
        put = {}
        for i, (word, tag) in enumerate(zip(words, tags)):
            new = word
            if tag == BEGIN:
                # the word's own key and mark go, what is left is the secret
                new = re.sub(r"""^.*[:=]["']?(?=[^:=]{6})""", "", word) if HIDDEN.search(word) else word
                if new != word and mark == "key" and i and tags[i - 1] == OUT:
                    put[i - 1] = mark
                core = new.strip(STRIP)
                if made_up and core:
                    letters = rng.choice(ALPHABETS)
                    new = new.replace(core, "".join(rng.choice(letters) for _ in range(rng.randint(SHORTEST, LONGEST))))
            elif tag == OUT:
                new = HIDDEN.sub("of", word)
                if mark and new.strip("\"'") in ("=", ":"):
                    new = mark
            if new != word and new:
                put[i] = new
        for i, new in put.items():
            words[i] = new
            c = CLASS["plain"] if is_plain(pa.array([new]))[0] else word_class(new)
            for at, side in ((i + 2, 0), (i + 1, 1), (i - 1, 2)):
                if 0 <= at < len(words):
                    near[3 * at + side] = c
        out.append({**window, "words": words, "near": near, "tags": tags})
    return out


class Field:
    """Weights of the field: shapes, neighbours (two before, before, after), file, and transitions; rows by feature, columns by tag."""

    def __init__(self):
        n = len(CLASSES)
        self.at = np.cumsum([0, N_SHAPES, n, n, n, N_FILE])
        self.w = np.zeros((self.at[-1], 3))
        self.t = np.zeros((3, 3))
        self.start, self.end = np.zeros(3), np.zeros(3)

    def fit(self, rows: list, rounds: int = 120, rate: float = 0.3, l2: float = 1e-4) -> Field:
        """Maximum likelihood over windows (words, near, tags, file), by Adam on full batches; forward-backward over all windows at once."""
        length = max(len(r["words"]) for r in rows)
        distinct = pa.array(sorted({w for r in rows for w in r["words"]}), pa.large_string())
        plain = is_plain(distinct)
        own = {w: [0] if p else shapes(w) for w, p in zip(distinct.to_pylist(), plain.tolist())}
        slots = 12 + 4
        x = np.full((len(rows), length, slots), self.at[-1], np.int32)
        y = np.zeros((len(rows), length), np.int64)
        mask = np.zeros((len(rows), length), bool)
        for i, r in enumerate(rows):
            for k, w in enumerate(r["words"]):
                f = own[w] + [self.at[1 + j] + v for j, v in enumerate(r["near"][3 * k : 3 * k + 3])] + [self.at[4] + r["file"]]
                x[i, k, : len(f)] = f
            y[i, : len(r["words"])] = r["tags"]
            mask[i, : len(r["words"])] = True
        n, steps = len(rows), np.arange(length)
        last = mask.sum(1) - 1
        # most places are plain words among plain words: scores and gradients are those of distinct places
        places, which = np.unique(x[mask], axis=0, return_inverse=True)
        which = which.reshape(-1)
        e = np.zeros((n, length, 3))
        by_feature = lambda p: np.stack([np.bincount(places.reshape(-1), np.repeat(np.bincount(which, p[:, t], len(places)), slots), self.at[-1] + 1) for t in range(3)], 1)
        padded = np.zeros((self.at[-1] + 1, 3))
        moment = [np.zeros_like(p) for p in (padded, self.t, self.start, self.end) for _ in (0, 1)]
        hot = np.eye(3)
        gold_t = np.einsum("nka,nkb,nk->ab", hot[y[:, :-1]], hot[y[:, 1:]], mask[:, 1:])
        gold = by_feature(hot[y[mask]])
        gold_s, gold_e = hot[y[:, 0]].sum(0), hot[y[np.arange(n), last]].sum(0)
        params = [padded, self.t, self.start, self.end]
        for step in range(1, rounds + 1):
            e[mask] = padded[places].sum(1)[which]
            a = np.zeros((n, length, 3))
            a[:, 0] = e[:, 0] + self.start
            for k in steps[1:]:
                s = a[:, k - 1, :, None] + self.t
                top = s.max(1)
                a[:, k] = np.where(mask[:, k, None], e[:, k] + top + np.log(np.exp(s - top[:, None]).sum(1)), a[:, k - 1])
            final = a[:, -1] + self.end
            z = final.max(1) + np.log(np.exp(final - final.max(1, keepdims=True)).sum(1))
            b = np.zeros((n, length, 3))
            b[:, -1] = self.end
            for k in steps[:-1][::-1]:
                s = self.t + (e[:, k + 1] + b[:, k + 1])[:, None, :]
                top = s.max(2)
                b[:, k] = np.where(mask[:, k + 1, None], top + np.log(np.exp(s - top[..., None]).sum(2)), b[:, k + 1])
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            pair = np.zeros((3, 3))
            for k in steps[1:]:
                s = a[:, k - 1, :, None] + self.t + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]
                pair += (np.exp(np.minimum(s, 0)) * mask[:, k, None, None]).sum(0)
            model = by_feature(p[mask])
            grads = [(gold - model) / n - l2 * padded, (gold_t - pair) / n - l2 * self.t, (gold_s - p[:, 0].sum(0)) / n, (gold_e - p[np.arange(n), last].sum(0)) / n]
            for j, (v, g) in enumerate(zip(params, grads)):
                m, q = moment[2 * j], moment[2 * j + 1]
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                v += rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
            padded[-1] = 0
        self.w = padded[:-1]
        return self

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each word's tags."""
        own = np.tile(self.w[0], (len(words.distinct), 1))
        for i, w in zip(words.odd.tolist(), words.odd_words):
            own[i] = self.w[shapes(w)].sum(0)
        e = own[words.at]
        for j, c in enumerate(words.neighbours()):
            e += self.w[self.at[1 + j] : self.at[2 + j]][c]
        return e + np.repeat(self.w[self.at[4] : self.at[5]][words.files()], np.diff(words.ends), axis=0)

    def tagged(self, window: dict) -> bool:
        """Whether the best tagging of a window has a secret."""
        plain = is_plain(pa.array(window["words"], pa.large_string()))
        e = np.array([self.w[[0] if p else shapes(w)].sum(0) for w, p in zip(window["words"], plain.tolist())])
        for j in range(3):
            e += self.w[self.at[1 + j] : self.at[2 + j]][np.array(window["near"][j::3])]
        return bool(self.decode(e + self.w[self.at[4] + window["file"]], np.array([0, len(e)])).any())

    def lead(self) -> float:
        """What a change of one tag to outside can cost in transitions at most."""
        t = np.vstack([self.t, self.start])
        u = np.hstack([self.t, self.end[:, None]])
        return float(max(t[a, x] + u[x, b] - t[a, OUT] - u[OUT, b] for a in range(4) for b in range(4) for x in (BEGIN, INSIDE)))

    def decode(self, e: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best tags of texts whose words' scores are e[ends[i] : ends[i + 1]]."""
        tags = np.zeros(len(e), np.int8)
        open_ = e[:, OUT] - e[:, 1:].max(1) <= self.lead()
        first = np.zeros(len(e) + 1, bool)
        first[ends] = True
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        begins = at[np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]])]
        stops = np.concatenate([at[:-1][(np.diff(at) > 1) | first[at[1:]]], at[-1:]]) + 1
        for a, z in zip(begins.tolist(), stops.tolist()):
            score = e[a] + (self.start if first[a] else self.t[OUT])
            back = []
            for k in range(a + 1, z):
                s = score[:, None] + self.t
                back.append(s.argmax(0))
                score = s.max(0) + e[k]
            score = score + (self.end if first[z] else self.t[:, OUT])
            tag = int(score.argmax())
            tags[z - 1] = tag
            for k in range(z - 2, a - 1, -1):
                tag = int(back[k - a][tag])
                tags[k] = tag
        return tags


def secrets_of(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans of tagged words, without quotes and marks around them."""
    spans: list[list[int]] = []
    for m, tag in zip(WORD.finditer(text), tags.tolist()):
        if tag == OUT:
            continue
        core = m[0].strip(STRIP)
        if not core:
            continue
        a = m.start() + m[0].index(core)
        if tag == INSIDE and spans:
            spans[-1][1] = a + len(core)
        else:
            spans.append([a, a + len(core)])
    return [(a, z) for a, z in spans]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field for the corpus; None if the patterns find nothing to learn from. At most 2 * sample short windows come to the driver."""
    # a share of the texts that is expected to have four times the windows needed; all of them where it has too few
    share = min(1.0, 4 * sample / max(1, docs.count()))
    rows = windows(docs, sample, share).collect()
    if share < 1 and sum(not r["positive"] for r in rows) < sample:
        rows = windows(docs, sample).collect()
    rows = sorted((r.asDict() for r in rows), key=lambda r: (r["rank"], r["words"]))
    found = [r for r in rows if r["positive"]]
    # at most as many variants as there are windows of one sort
    taught = [v for r in found[: -(-sample // 3)] for v in variants(r)]
    if not found:
        return None
    first = Field().fit(rows + taught)
    # a window elsewhere that looks like a secret for all that may be one which no pattern knows: it teaches neither
    known = [r for r in rows if r["positive"] or not first.tagged(r)]
    return first if len(known) == len(rows) else Field().fit(known + taught)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, spans of every row of docs (doc_id, text): kind, start, end in code points, and value, by start, then kind.

    Kinds are those of the patterns, and ``crf`` for what the field adds beside them.
    """
    docs = docs.select("doc_id", "text")
    field = field or train(docs)
    span = "array<struct<kind:string,start:long,end:long,value:string>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1, 8_000_000):
            texts = b.column(1).cast(pa.large_string()).fill_null("")
            found: list[list[tuple]] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(hinted(texts)).tolist():
                found[i] = [(a, k, z) for a, k, z, _ in base_spans(texts[i].as_py())]
            if field:
                words = Words(texts)
                tags = field.decode(field.emissions(words), words.ends)
                hits = np.unique(np.searchsorted(words.ends, np.flatnonzero(tags), side="right") - 1)
                for i in hits.tolist():
                    base = found[i]
                    more = secrets_of(texts[i].as_py(), tags[words.ends[i] : words.ends[i + 1]])
                    found[i] = sorted(base + [(a, len(KINDS), z) for a, z in more if not any(s < z and a < t for s, _, t in base)])
            out = []
            for i, spans in enumerate(found):
                text = texts[i].as_py() if spans else ""
                out.append([{"kind": (*KINDS, ADDED)[k], "start": a, "end": z, "value": text[a:z]} for a, k, z in spans])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, kinds)], ["doc_id", "spans"])

    return docs.mapInArrow(work, f"doc_id long, spans {span}")
