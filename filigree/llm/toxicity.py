"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares words as sequences of letters. It counts common subsequences of three letters within
``SPAN`` letters, each weighted by ``DECAY`` to the power of the letters it stretches over, so that a
gapped or misspelt insult stays close to the plain one, and the machine is trained on written misspellings (a letter
put in, doubled or left out) of the toxic words it finds, unless they are about as close to a clean word; marks inside a word ("i.d.i.o.t"), digits in
place of letters and single spaced-out letters are undone before. It is normalised by the lengths of both
words. No text is split into sentences: a word of a clean document is clean; of a toxic document at least one
word is toxic: at first the words that explain most toxic documents and few clean ones, then those of the highest
margins, by turns (multiple-instance learning). Insults of several ordinary words are
not found. Nystroem features of a word are its
kernel values with the landmarks times the inverse square root of the landmarks' own kernel matrix; as
they are linear in the word's subsequences, the trained machine folds into one table of subsequence
weights, and scoring is linear in the length of the text.

Null and empty texts, and texts without a word of three letters, get the score of the margin ``FLOOR``.
Repeated rows each get their score. Other columns are neither read nor changed.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, held_out

DECAY = 0.6
SPAN = 6
LETTERS = 64
#: Longer words are cut into overlapping pieces of ``PIECE`` letters.
LONG, PIECE, STEP = 20, 16, 8
FLOOR = -3.0
#: A word of three letters with its edges; shorter ones are not looked at.
SHORT = 5
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
#: A word stands for toxic documents if its share of the clean ones is at most this times its share of the toxic ones.
RARE = 0.1
#: Toxic words with a higher kernel value with a clean one have no misspelt forms: those could be the clean word as well.
NEAR = 0.6
#: What a toxic word's misspelt forms count together, against the word in training and against its document at the cut.
FORMS, FORMS_AT_CUT = 3.0, 0.4
#: Words whose kernel values or features training copies at a time: 10 MB.
ROWS = 2048
#: Digits that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
DROPPED, BREAK = 254, 255
#: Stands before and after each word, so that its first and last letters count as such.
EDGE = 0


def _letter_codes() -> np.ndarray:
    codes = np.full(1 << 16, DROPPED, np.uint8)
    for cp in range(1 << 16):
        ch = chr(cp)
        if ch.isspace():
            codes[cp] = BREAK
        elif "a" <= ch <= "z":
            codes[cp] = cp - 96
        elif ch.isalpha():
            codes[cp] = 27 + cp % 37
    for digit, ch in LEET.items():
        codes[ord(digit)] = ord(ch) - 96
    return codes


_CODES: np.ndarray | None = None


def codes_of(text: str) -> np.ndarray:
    global _CODES
    if _CODES is None:
        _CODES = _letter_codes()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODES[np.minimum(points, 0xFFFF)]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k] + sizes[k] - 1, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Words:
    """Letters of all words in a row; a word of ``doc`` k starts at ``start`` and has ``size`` letters."""

    letters: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray

    def word(self, k: int) -> bytes:
        return self.letters[self.start[k] : self.start[k] + self.size[k]].tobytes()


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    code = codes_of(" ".join(low))
    ends = np.cumsum([len(t) + 1 for t in low])
    kept = np.flatnonzero(code < LETTERS)
    token = np.cumsum(code == BREAK)[kept]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(kept) else kept
    size = np.diff(np.r_[first, len(kept)])
    doc = np.searchsorted(ends, kept[first], "right")
    if len(first) > 1:  # single letters in a row are one spaced-out word
        lone = size == 1
        joined = np.r_[False, lone[1:] & lone[:-1] & (doc[1:] == doc[:-1])]
        head = np.flatnonzero(~joined)
        size, first, doc = np.add.reduceat(size, head), first[head], doc[head]
    pieces = np.where(size > LONG, -(-(size - PIECE) // STEP) + 1, 1)
    if (pieces > 1).any():
        owner = np.repeat(np.arange(len(size)), pieces)
        shift = _ragged(np.zeros(len(size), int), pieces) * STEP
        piece = np.where(pieces[owner] > 1, np.minimum(PIECE, size[owner] - shift), size[owner])
        first, size, doc = first[owner] + shift, piece, doc[owner]
    out = np.full(size.sum() + 2 * len(size), EDGE, np.uint8)
    start = np.cumsum(size + 2) - size - 2
    out[_ragged(start + 1, size)] = code[kept][_ragged(first, size)]
    return Words(out, start, size + 2, doc)


def _words(words: list[bytes]) -> Words:
    size = np.array([len(w) for w in words], int)
    return Words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, np.arange(len(words)))


def _scale(size: np.ndarray) -> np.ndarray:
    """1 over the root of a word's kernel with itself, were all its subsequences different."""
    total = sum(np.maximum(size - (a + b), 0) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS)
    return np.where(total > 0, 1 / np.sqrt(np.maximum(total, 1e-12)), 0)


def _triples(w: Words):
    """For each pair of gaps: where its subsequences start, their numbers, and their weight."""
    c = w.letters.astype(np.int32)
    owner = np.repeat(np.arange(len(w.size), dtype=np.int32), w.size)
    for a, b in GAPS:
        n = len(c) - a - b
        if n > 0:
            at = np.flatnonzero(owner[:n] == owner[a + b :])
            yield at, (c[at] * LETTERS + c[at + a]) * LETTERS + c[at + a + b], DECAY ** (a + b + 1)


def margins(w: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each word; words without a subsequence get FLOOR."""
    if not len(w.size):
        return np.zeros(0)
    total = np.zeros(len(w.letters), np.float32)
    for at, number, weight in _triples(w):
        total[at] += table[number] * np.float32(weight)
    sums = np.add.reduceat(total, w.start) * _scale(w.size)
    return np.where(w.size < SHORT, FLOOR, sums + bias)


def kernel(words: list[bytes], landmarks: list[bytes], block: int = 16) -> np.ndarray:
    """Kernel values of all words with all landmarks."""
    w = _words(words)
    owner = np.repeat(np.arange(len(words)), w.size)
    found = [(owner[at], number, weight) for at, number, weight in _triples(w)]
    out = np.zeros((len(words), len(landmarks)))
    for k in range(0, len(landmarks), block):
        part = landmarks[k : k + block]
        dense = np.zeros((LETTERS**3, len(part)), np.float32)
        lw = _words(part)
        low = np.repeat(np.arange(len(part)), lw.size)
        for at, number, weight in _triples(lw):
            np.add.at(dense, (number, low[at]), weight)
        for rows, number, weight in found:
            if len(rows):  # in order of the words, so each word is one run
                head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                out[rows[head], k : k + len(part)] += np.add.reduceat(dense[number], head) * weight
    return out * _scale(w.size)[:, None] * _scale(np.array([len(x) for x in landmarks]))[None, :]


def _fold(landmarks: list[bytes], beta: np.ndarray) -> np.ndarray:
    table = np.zeros(LETTERS**3)
    w = _words(landmarks)
    own = np.repeat(beta * _scale(w.size), w.size)
    for at, number, weight in _triples(w):
        np.add.at(table, number, own[at] * weight)
    return table.astype(np.float32)


def _features(words: list[bytes], landmarks: list[bytes], root: np.ndarray) -> np.ndarray:
    """Nystroem features of all words and a last column of ones; kernel values are held for ROWS words at a time."""
    x1 = np.ones((len(words), root.shape[1] + 1))
    for k in range(0, len(words), ROWS):
        x1[k : k + ROWS, :-1] = kernel(words[k : k + ROWS], landmarks) @ root
    return x1


def _svm(x1: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 10.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and balanced classes, by Newton steps on its support vectors.

    x1: features, the last of them 1. share: what each row counts within its class. No second table of the features' size is made.
    """
    share = share * np.where(y > 0, len(y) / 2 / max(share[y > 0].sum(), 1e-9), len(y) / 2 / max(share[y < 0].sum(), 1e-9))
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        active = np.flatnonzero(y * (x1 @ w) < 1)
        left, right = ridge.copy(), np.zeros(len(w))
        for k in range(0, len(active), ROWS):
            rows = active[k : k + ROWS]
            xa = x1[rows]
            xc = (xa * (cost * share[rows])[:, None]).T
            left += xc @ xa
            right += xc @ y[rows]
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _probability(m: np.ndarray, y: np.ndarray, forms: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of documents with margins m and labels y.

    0.5 is at the cut with the fewest errors (the widest gap of those), where the margins of misspelt insults
    (``forms``) count together ``FORMS_AT_CUT`` times the toxic documents; the slope is the likeliest one for the labels,
    smoothed by one case each.
    """
    each = FORMS_AT_CUT * y.sum() / max(len(forms), 1)
    order = np.argsort(np.r_[m, forms], kind="stable")
    ms, toxic = np.r_[m, forms][order], np.r_[y, np.full(len(forms), each)][order]
    clean = np.r_[1 - y, np.zeros(len(forms))][order]
    errors = np.round(np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(clean[::-1])[::-1], 0], 6)
    gap = np.diff(np.r_[ms[0] - 0.1, ms, ms[-1] + 0.1])
    best = max(np.flatnonzero(gap > 1e-9), key=lambda k: (-errors[k], gap[k]))
    cut = np.r_[ms[0] - 0.1, ms][best] + gap[best] / 2
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slopes = np.geomspace(0.5, 50, 60)
    z = np.clip(slopes[:, None] * (m - cut), -30, 30)
    loss = (np.log1p(np.exp(z)) - t * z).sum(1)
    slope = float(slopes[loss.argmin()])
    return slope, -slope * float(cut)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: list[bytes]

    def margin(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), FLOOR)
        w = words_of(texts)
        np.maximum.at(out, w.doc, margins(w, self.table, self.bias))
        return out

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, part in chunks(texts):
            z = np.clip(self.slope * self.margin(part) + self.offset, -30, 30)
            out[start : start + len(part)] = 1 / (1 + np.exp(-z))
        return out


def _cover(bags: list[set[bytes]], telling, depth: int) -> dict[bytes, int]:
    """Words that explain the toxic documents, each up to ``depth`` times: again and again the telling word that
    most of the documents hold that are not explained as often yet."""
    holders: dict[bytes, list[int]] = {}
    for k, bag in enumerate(bags):
        for word in filter(telling, bag):
            holders.setdefault(word, []).append(k)
    heap = [(-len(found), word) for word, found in holders.items()]
    heapq.heapify(heap)
    found: dict[bytes, int] = {}
    left = [depth] * len(bags)
    while heap:
        gain, word = heapq.heappop(heap)
        open_ = [k for k in holders[word] if left[k]]
        if len(open_) < -gain:
            if open_:
                heapq.heappush(heap, (-len(open_), word))
            continue
        found[word] = len(open_)
        for k in open_:
            left[k] -= 1
    most = max(found.values(), default=0)
    return {word: n for word, n in found.items() if n >= min(3, most)}


def misspelt(word: bytes, rng: np.random.Generator, count: int) -> list[bytes]:
    """Forms of a word (with its edges) with one letter a to z put in, doubled or left out, never its first or last."""
    inner = word[1:-1]
    at = rng.integers(1, max(len(inner), 2), count)
    letters = rng.integers(1, 27, count)
    forms = []
    for k, (i, letter) in enumerate(zip(at, letters, strict=True)):
        if k % 4 == 0 and len(inner) > 4:
            i = min(i, len(inner) - 2)
            forms.append(inner[:i] + inner[i + 1 :])
        else:
            forms.append(inner[:i] + (inner[i - 1 : i] if k % 4 == 1 else bytes([letter])) + inner[i:])
    return [word[:1] + f + word[-1:] for f in sorted(set(forms))]


def fit(texts: list[str], y: np.ndarray, landmarks: int = 640, rounds: int = 3, depth: int = 5, examples: int = 10000, misspellings: int = 160, seed: int = 7) -> Model:
    """Train on labelled documents (1: toxic). Without both labels the score is a constant 0.

    landmarks: at most so many words, half of them toxic, half of them the clean words closest to them.
    rounds: how often the toxic words of each toxic document are looked for anew; depth: at most so many of one document.
    examples: at most so many clean words besides those closest to toxic ones, chosen at random (half of those closest
    stay for the next round), and at most so many misspelt forms.
    misspellings: at most so many written forms of each toxic word that two or more documents hold.
    """
    y = np.asarray(y).astype(int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(LETTERS**3, np.float32), 0.0, 1.0, -30.0, [])
    rng = np.random.default_rng(seed)
    clean: dict[bytes, int] = {}
    toxic: dict[bytes, int] = {}
    bags: list[set[bytes]] = []
    for start, part in chunks(texts, 1 << 18):
        w = words_of(part)
        found: list[set[bytes]] = [set() for _ in part]
        for k in np.flatnonzero(w.size >= SHORT):
            found[w.doc[k]].add(w.word(k))
        for bag, label in zip(found, y[start : start + len(part)], strict=True):
            seen = toxic if label else clean
            for word in bag:
                seen[word] = seen.get(word, 0) + 1
            if label:
                bags.append(bag)
    most = RARE * (y == 0).sum() / (y == 1).sum()

    def telling(word: bytes) -> bool:
        """Whether a word may stand for a toxic document: its share among the clean ones is small."""
        return clean.get(word, 0) <= max(1, most * toxic.get(word, 0))

    def witnesses(w: Words, m: np.ndarray, order: np.ndarray) -> list[bytes]:
        """The telling words of a document that have the highest margins: one, and others above the machine's border."""
        found: list[bytes] = []
        for k in order:
            if len(found) == depth or (found and m[k] <= 0):
                break
            if w.size[k] >= SHORT and (word := w.word(k)) not in found and telling(word):
                found.append(word)
        return found

    pos = _cover(bags, telling, depth)
    common = sorted(clean, key=lambda x: (-clean[x], x))
    neg = {common[i]: 0.0 for i in rng.permutation(len(common))[:examples] if common[i] not in pos}
    table, bias, marks, forms = np.zeros(LETTERS**3, np.float32), 0.0, [], []
    for turn in range(rounds + 1):
        if turn:
            pos, close = {}, {}
            for start, part in chunks(texts, 1 << 18):
                w = words_of(part)
                m = margins(w, table, bias)
                order = np.lexsort((-m, w.doc))
                head = np.flatnonzero(np.r_[True, w.doc[order][1:] != w.doc[order][:-1]]) if len(order) else order
                last = np.r_[head[1:], len(order)]
                for h, e in zip(head, last, strict=True):
                    if y[start + w.doc[order[h]]]:
                        for word in witnesses(w, m, order[h:e]):
                            pos[word] = pos.get(word, 0) + 1
                    else:
                        for k in {h, min(h + 1, e - 1), int(rng.integers(h, e))}:
                            if len(word := w.word(order[k])) >= SHORT:
                                close[word] = float(m[order[k]])
            neg = {word: margin for word, margin in zip(hard, margins(_words(hard), table, bias), strict=True)} | close
        for word in set(pos) & set(neg):
            if pos[word] > 1:
                del neg[word]
            else:
                del pos[word]
        good = sorted(pos, key=lambda x: (-pos[x], x))
        bad = sorted(neg, key=lambda x: (-neg[x], x))
        hard = bad[: examples // 2]
        if not good or not bad:
            break
        repeated = [x for x in good if pos[x] > 1][: landmarks // 2] or good[: landmarks // 2]
        marks = good[: landmarks // 2] + bad[: landmarks // 2]
        rest = bad[landmarks // 2 :]
        bad = bad[: landmarks // 2] + [rest[i] for i in rng.permutation(len(rest))[:examples]]
        near = kernel(repeated, bad[: landmarks // 2]).max(1)
        repeated = [x for x, closest in zip(repeated, near, strict=True) if closest < NEAR]
        each = max(1, min(misspellings, examples // max(len(repeated), 1)))
        written = [(x, f) for x in repeated for f in misspelt(x, rng, each) if f not in clean and f not in neg]
        forms = [f for _, f in written]
        val, vec = np.linalg.eigh(kernel(marks, marks))
        root = vec[:, val > 1e-8] / np.sqrt(val[val > 1e-8])
        x1 = _features(good + forms + bad, marks, root)
        share = np.r_[[pos[g] for g in good], [FORMS * pos[g] / each for g, _ in written], np.ones(len(bad))]
        weight, bias = _svm(x1, np.r_[np.ones(len(good) + len(forms)), -np.ones(len(bad))], share)
        del x1
        table = _fold(marks, root @ weight)
    model = Model(table, bias, 1.0, 0.0, marks)
    m = np.concatenate([model.margin(part) for _, part in chunks(texts)])
    model.slope, model.offset = _probability(m, y, margins(_words(forms), table, bias))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Text and label of at most so many documents of each label, the same ones at every run.

    The ids are cut to the bound on the small table first; that bounded list is then broadcast to the texts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [known.filter(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in enumerate((clean, toxic))]
    picked = ids[0].unionByName(ids[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    return (
        docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_toxic").alias("toxic"))
    )


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the pickled model of all rows (doc_id, text, toxic) of a bounded sample."""
    parts = list(batches)
    if parts:
        rows = pd.concat(parts).sort_values(["doc_id", "toxic", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["toxic"].to_numpy()))]})


def train(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 5000) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out: so many documents of each label.

    The sample goes to one task, and only the model comes to the driver, whose memory a whole pipeline shares.
    """
    bounded_batches(docs.sparkSession)
    rows = training_sample(docs, labels, toxic, clean).repartition(1)
    found = rows.mapInPandas(_fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0, int))


def toxicity(model: Model, text: str | Column, spark) -> Column:
    """The score of a text column, 0 to 1."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return score(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted (1 from a score of 0.5)."""
    scored = docs.withColumn("score", toxicity(model, F.col("text"), docs.sparkSession))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
