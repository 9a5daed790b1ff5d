"""Scores for abusive, hateful or sexual content (problem 8).

A bidirectional gated recurrent network with attention pooling reads windows of WINDOW
words that overlap by half; in scripts without spaces every character is a word. A word
enters as the sum of a word vector and the mean of vectors of all its distinct character
3- and 4-grams, both from a hashed table, so that new and misspelt words have vectors too. The network is trained in numpy on a bounded sample of the reviewers'
judgements (at most `max_labelled` documents); every window of every document is scored,
and a document has the score of its worst window.

Reviewers judge documents, not windows, and some are wrong. The windows that count as
abusive are at first those with the most telling words, later those the network itself
scores highest, among all windows of the document. Every epoch reads up to NEGATIVES windows
of each fine document, drawn anew from all of them. A judgement that the words of all other judged documents contradict is
doubtful and left out of the training; such documents and those held out set the threshold.

Defined cases: null, empty and wordless texts have score 0; repeated texts have equal
scores; labels of documents that don't exist are ignored; of differing labels of one
document the higher counts as a doubtful one and the document is left out of the training;
without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import Shared, cut, spread, table

WINDOW, STRIDE = 16, 8
TABLE, DIM, HIDDEN, ATTENTION = 1 << 15, 24, 24, 16
LEAST_CELLS = 15
EMBED_BLOCK = 1 << 18
MOST_CELLS = 1_000_000
MAX_LABELLED = 6000
LEAST_STEPS = 400
HELD_OUT = 0.15
NEGATIVES = 64

# Look-alikes of Latin letters, and digits and signs written for letters.
LOOKALIKES = str.maketrans("асеорхуіјѕкмтвнαορυικτνеԁɡıłøđ", "aceopxyijskmtbhaopuiktvedgilod")
LEET = str.maketrans("01345789@$!|", "oieastbgasil")

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_DOTTED = re.compile(r"(?<=[^\W\d_])[.\-_](?=[^\W\d_][.\-_]|[^\W\d_]\b)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
# Ranges of the scripts that put no spaces between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}](?:(?:[^\W{_UNSPACED}]|[@$*!|'’])*(?:[^\W{_UNSPACED}]|\*))?")


def words_of(text: str) -> list[str]:
    """Words in one spelling: no accents, look-alikes, spacing, stretching or digits for letters."""
    text = re.sub(r"[-‐¬­]\r?\n", "", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and c != "​")
    text = text.lower().translate(LOOKALIKES)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    out = []
    for word in _WORD.findall(_RUN.sub(r"\1", text)):
        if not word.isalpha() and any(c.isalpha() for c in word):
            word = re.sub(r"\*+", "*", word.translate(LEET) if not word.isdigit() else word)
        elif word.isdigit():
            word = "0"
        out.append(word)
    return out


def hashed(text: str) -> int:
    return 1 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % (TABLE - 1)


def word_cells(word: str) -> tuple[list[int], list[float]]:
    """Cells of the table that a word adds up, with weights: the word and its distinct character 3- and 4-grams.

    Both are filled up to LEAST_CELLS with cell 0, which is no n-gram's.
    """
    edged = f"<{word}>"
    grams = list(dict.fromkeys([edged[i : i + n] for n in (3, 4) for i in range(len(edged) - n + 1)]))
    cells = [hashed(f"w {word}")] + [hashed(g) for g in grams]
    weights = [1.0] + [1.0 / len(grams)] * len(grams)
    pad = LEAST_CELLS - len(cells)
    return cells + [0] * pad, weights + [0.0] * pad


def taken(cells: np.ndarray, weights: np.ndarray, starts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cells, weights and starts of some words only, in their order."""
    lengths = np.diff(starts, append=len(cells))[used]
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[used] - first[:-1], lengths) + np.arange(first[-1])
    return cells[at], weights[at], first[:-1]


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows over n words."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """The parameters, the forward pass, and the backward pass for training."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {"table": (rng.standard_normal((TABLE, DIM)) * 0.02).astype(f)}
        self.p["table"][0] = 0
        for side in "fb":
            self.p["x" + side] = (rng.standard_normal((DIM, 3 * HIDDEN)) / np.sqrt(DIM)).astype(f)
            self.p["h" + side] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f)
            self.p["b" + side] = np.zeros(3 * HIDDEN, f)
        self.p["att"] = (rng.standard_normal((2 * HIDDEN, ATTENTION)) / np.sqrt(2 * HIDDEN)).astype(f)
        self.p["query"] = (rng.standard_normal(ATTENTION) / np.sqrt(ATTENTION)).astype(f)
        self.p["out"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(f)
        self.p["bias"] = np.zeros(1, f)

    def embed(self, cells: np.ndarray, weights: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """Vectors of words; cells and weights are flat with each word's first place in starts, or matrices."""
        if starts is None:
            starts, cells, weights = np.arange(len(cells)) * cells.shape[1], cells.ravel(), weights.ravel()
        owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(cells)))
        out = np.zeros((len(starts), DIM), np.result_type(weights, self.p["table"]))
        for lo in range(0, len(cells), EMBED_BLOCK):
            hi = lo + EMBED_BLOCK
            own = owner[lo:hi]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[first]] += np.add.reduceat(weights[lo:hi, None] * self.p["table"][cells[lo:hi]], first, axis=0)
        return out

    def run_side(self, pre: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, rows, HIDDEN) of one direction over pre (steps, rows, 3 HIDDEN)."""
        u, n = self.p["h" + side], HIDDEN
        steps = range(len(pre)) if side == "f" else range(len(pre) - 1, -1, -1)
        h = np.zeros((pre.shape[1], n), np.float32)
        out = np.empty((len(pre), pre.shape[1], n), np.float32)
        for t in steps:
            hu = h @ u
            zr = sigmoid(pre[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(pre[t, :, 2 * n :] + r * hu[:, 2 * n :])
            new = c + z * (h - c)
            new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n :]))
            h = out[t] = new
        return out

    def forward(self, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; pre_* are (steps, rows, 3 HIDDEN), mask (steps, rows)."""
        tapes = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.run_side(pre_f, mask, "f", tapes[0]), self.run_side(pre_b, mask, "b", tapes[1])], 2)
        a = np.tanh(h @ self.p["att"])
        score = np.where(mask, a @ self.p["query"], -1e9)
        score -= score.max(0)
        w = np.exp(score)
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if keep is not None:
            keep.update(h=h, a=a, w=w, pooled=pooled, tapes=tapes, mask=mask)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, ids: np.ndarray, cells: np.ndarray, weights: np.ndarray, goal: np.ndarray, scale: np.ndarray, starts: np.ndarray | None = None):
        """Loss and gradients for windows ids (rows, steps; -1 is no word) of words with cells and weights."""
        mask = (ids >= 0).T
        v = self.embed(cells, weights, starts)
        x = np.where(mask[:, :, None], v[np.maximum(ids, 0).T], 0)
        keep: dict = {}
        logit = self.forward(x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"], mask, keep)
        prob = sigmoid(logit)
        loss = -np.mean(scale * (goal * np.log(prob + 1e-7) + (1 - goal) * np.log(1 - prob + 1e-7)))
        g = {k: np.zeros_like(p) for k, p in self.p.items() if k != "table"}
        d = (scale * (prob - goal) / len(goal)).astype(np.float32)
        g["bias"][0], g["out"] = d.sum(), keep["pooled"].T @ d
        dpool = d[:, None] * self.p["out"]
        h, a, w = keep["h"], keep["a"], keep["w"]
        dh = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", h, dpool)
        ds = w * (dw - (w * dw).sum(0))
        g["query"] = np.einsum("tn,tna->a", ds, a)
        da = ds[:, :, None] * self.p["query"] * (1 - a * a)
        g["att"] = np.einsum("tnh,tna->ha", h, da)
        dh = dh + da @ self.p["att"].T
        dx = np.zeros_like(x)
        n = HIDDEN
        for side, tape, part in (("f", keep["tapes"][0], dh[:, :, :n]), ("b", keep["tapes"][1], dh[:, :, n:])):
            u = self.p["h" + side]
            back = np.zeros((ids.shape[0], n), np.float32)
            dpre = np.zeros((len(x), ids.shape[0], 3 * n), np.float32)
            for t, before, z, r, c, huc in reversed(tape):
                dnew = part[t] + back
                live = mask[t][:, None]
                dn = np.where(live, dnew, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (before - c) * z * (1 - z)
                dr = dc * huc * r * (1 - r)
                dpre[t] = np.concatenate([dz, dr, dc], 1)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                g["h" + side] += before.T @ dhu
                back = np.where(live, dn * z + dhu @ u.T, dnew)
            g["b" + side] = dpre.sum((0, 1))
            g["x" + side] = np.einsum("tnd,tng->dg", x, dpre)
            dx += dpre @ self.p["x" + side].T
        dv = np.zeros_like(v)
        np.add.at(dv, ids.T[mask], dx[mask])
        return float(loss), g, dv


class Trainer:
    """Adam for the dense parameters, Adagrad for the cells a batch touches."""

    def __init__(self, net: Network, rate: float = 0.004):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(p) for k, p in net.p.items() if k != "table"}
        self.v = {k: np.zeros_like(p) for k, p in self.m.items()}
        self.seen = np.full(TABLE, 0.1, np.float32)

    def step(self, ids: np.ndarray, cells: np.ndarray, weights: np.ndarray, starts: np.ndarray, goal: np.ndarray, scale: np.ndarray) -> float:
        used, back = np.unique(np.maximum(ids, 0), return_inverse=True)
        local = np.where(ids >= 0, back.reshape(ids.shape), -1)
        cells, weights, starts = taken(cells, weights, starts, used)
        loss, g, dv = self.net.gradients(local, cells, weights, goal, scale, starts)
        self.t += 1
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            self.net.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)
        rows, at = np.unique(cells, return_inverse=True)
        owner = np.repeat(np.arange(len(used)), np.diff(starts, append=len(cells)))
        sums = np.zeros((len(rows), DIM), np.float32)
        np.add.at(sums, at, weights[:, None] * dv[owner])
        self.seen[rows] += (sums * sums).mean(1) * 1e3
        self.net.p["table"][rows] -= 0.05 * sums / np.sqrt(self.seen[rows])[:, None] * 10
        self.net.p["table"][0] = 0
        return loss


class Vocabulary:
    """Words met so far with their cells."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.cells, self.weights, self.starts = array("i"), array("f"), array("q")

    def add(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int32)
        for i, w in enumerate(words):
            n = self.ids.get(w)
            if n is None:
                n = self.ids[w] = len(self.starts)
                self.starts.append(len(self.cells))
                cells, weights = word_cells(w)
                own = cells.index(0) if cells[-1] == 0 else len(cells)
                self.cells.extend(cells[:own])
                self.weights.extend(weights[:own])
            out[i] = n
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells and weights of all words, and where each word's begin."""
        return np.array(self.cells, np.int32), np.array(self.weights, np.float32), np.array(self.starts, np.int64)


def window_matrix(ids: np.ndarray) -> np.ndarray:
    starts = windows(len(ids))
    out = np.full((len(starts), WINDOW), -1, np.int32)
    for row, s in enumerate(starts):
        part = ids[s : s + WINDOW]
        out[row, : len(part)] = part
    return out


def shifted(ids: np.ndarray, start: int) -> np.ndarray:
    """The window of a document at any start, held within the document."""
    start = max(0, min(start, len(ids) - 1))
    part = ids[start : start + WINDOW]
    return np.concatenate([part, np.full(WINDOW - len(part), -1, np.int32)]).astype(np.int32)


def word_counts(docs: list[list[str]], toxic: np.ndarray) -> tuple[Counter, Counter]:
    """Documents judged fine and judged abusive that have each word and word pair."""
    counts = (Counter(), Counter())
    for words, y in zip(docs, toxic):
        counts[int(y)].update(set(zip(words, words[1:])) | {(w,) for w in words})
    return counts


def telling(words: list[str], own: int, counts: tuple[Counter, Counter], n: tuple[int, int]) -> np.ndarray:
    """For each window the log-odds of its four most telling words or pairs, by the other documents.

    own is the judgement of the document itself, which is taken out of the counts. With
    many judgements a word must occur in some other abusive documents to tell anything.
    """
    least = max(1, min(3, n[1] // 300))

    def odds(g: tuple[str, ...]) -> float:
        bad, fine = counts[1][g] - own, counts[0][g] - (1 - own)
        return float(np.log((bad + 0.5) / (n[1] + 1)) - np.log((fine + 0.5) / (n[0] + 1))) if bad >= least else 0.0

    known = {g: odds(g) for g in {*zip(words, words[1:]), *((w,) for w in words)}}
    out = []
    for s in windows(len(words)):
        part = words[s : s + WINDOW]
        out.append(sum(sorted((known[g] for g in {*zip(part, part[1:]), *((x,) for x in part)}), reverse=True)[:4]))
    return np.array(out, np.float32)


def sound_judgements(most: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether the other documents' words bear out each judgement.

    Abusive documents fall into two groups by two means; where the lower group looks like
    the fine documents it is doubtful, and so are fine documents that look like the upper.
    Where it doesn't, only abusive documents that look like fine ones are doubtful.
    """
    floor, low, high = float(np.quantile(most[toxic == 0], 0.97)), float(most[toxic == 1].min()), float(most[toxic == 1].max())
    for _ in range(50):
        below = most[toxic == 1] <= (low + high) / 2
        if below.all() or not below.any():
            break
        low, high = float(most[toxic == 1][below].mean()), float(most[toxic == 1][~below].mean())
    cut = (low + high) / 2 if low <= floor else floor
    return np.where(toxic == 1, most > cut, most <= max(cut, floor))


def train(docs: list[str], toxic: np.ndarray, seed: int = 1, epochs: int = 3) -> tuple[Network, np.ndarray]:
    """A network from judged documents, and how much each of them counts for its threshold.

    Those it learns from count nothing, those held out count for them, doubtful ones once.
    """
    rng = np.random.default_rng(seed)
    net, vocabulary = Network(seed), Vocabulary()
    words = [words_of(d) for d in docs]
    counts, n = word_counts(words, toxic), (int((toxic == 0).sum()), int(toxic.sum()))
    mats, current, starts, numbers = [], [], [], [vocabulary.add(w) for w in words]
    for w, ids, y in zip(words, numbers, toxic):
        m, score, at = window_matrix(ids), telling(w, int(y), counts, n), np.array(windows(len(w)), np.int64)
        mats.append(m)
        current.append(score)
        starts.append(at)
    # Judgements that the other documents contradict are doubtful and teach nothing.
    most = np.array([s.max() if len(s) else 0.0 for s in current])
    sound = sound_judgements(most, toxic)
    flat = vocabulary.arrays()
    held = rng.random(len(docs)) < HELD_OUT
    fit = [i for i in range(len(docs)) if not held[i] and len(mats[i]) and sound[i]]
    trainer = Trainer(net)
    epoch = 0
    while epoch < epochs or trainer.t < LEAST_STEPS:
        good = [i for i in fit if toxic[i] == 1]
        tops = [int(np.argmax(current[i])) for i in good]
        # The telling words are shown at several places of the window and among other words.
        pos = [mats[i][t] for i, t in zip(good, tops)]
        pos += [shifted(numbers[i], int(starts[i][t]) + int(by)) for i, t in zip(good, tops) for by in rng.integers(-5, 6, 3)]
        neg = [m for i in fit if toxic[i] == 0 for m in (mats[i] if len(mats[i]) <= NEGATIVES else mats[i][rng.choice(len(mats[i]), NEGATIVES, replace=False)])]
        if not pos or not neg:
            return net, np.zeros(len(docs))
        pos, neg = np.array(pos), np.array(neg)
        x = np.concatenate([pos, neg])
        y = np.concatenate([np.ones(len(pos), np.float32), np.zeros(len(neg), np.float32)])
        order = rng.permutation(len(x))
        trainer.rate = 0.004 / (1 + trainer.t / 250)
        for lo in range(0, len(x), 256):
            b = order[lo : lo + 256]
            part = np.where(rng.random((len(b), WINDOW)) < 0.12, -1, x[b])
            part[:, 0] = np.where((part >= 0).any(1), part[:, 0], x[b][:, 0])
            trainer.step(part, *flat, y[b], np.ones(len(b), np.float32))
        seen = [i for i in range(len(docs)) if len(mats[i]) and sound[i] and (toxic[i] == 1 or held[i])]
        scores = score_windows(net, np.concatenate([mats[i] for i in seen]), *flat)
        for i, part in zip(seen, np.split(scores, np.cumsum([len(mats[i]) for i in seen])[:-1])):
            current[i] = part
        epoch += 1
    # Doubtful judgements are not learnt from. Among them are strong words that insult nobody,
    # which the threshold must tell from insults; wrong ones count alike at every threshold.
    return net, np.where(~sound, 1.0, np.where(held, 1 / HELD_OUT, 0.0))


FIRST_CUT, CUT_STEP, CUTS = -1.4, 0.2, 38


def threshold(bins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the cuts with the best F1; cuts are even in log-odds, from 0.2 to 0.998, bins how many of them a score reaches."""
    if not weights.sum() or not (weights * toxic).sum():
        return 0.5
    f1 = [2 * (weights * toxic)[bins > k].sum() / max(1e-9, weights[bins > k].sum() + (weights * toxic).sum()) for k in range(CUTS)]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(1 / (1 + np.exp(-(FIRST_CUT + CUT_STEP * best[len(best) // 2]))))


def score_windows(net: Network, mat: np.ndarray, cells: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Scores of windows of word numbers; the words' input products are made once a word."""
    out = np.empty(len(mat), np.float32)
    used, back = np.unique(np.maximum(mat, 0), return_inverse=True)
    back = back.reshape(mat.shape)
    v = net.embed(*taken(cells, weights, starts, used))
    pre = [v @ net.p["x" + s] + net.p["b" + s] for s in "fb"]
    for lo in range(0, len(mat), 1024):
        at, mask = back[lo : lo + 1024].T, (mat[lo : lo + 1024] >= 0).T
        out[lo : lo + 1024] = sigmoid(net.forward(pre[0][at], pre[1][at], mask))
    return out


def agreed_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the documents whose judgements agree."""
    sides = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    return sides.filter("toxic = other").select("doc_id", "toxic")


def labelled_sample(documents: DataFrame, agreed: DataFrame, most: int, seed: int = 0) -> pd.DataFrame:
    """At most `most` judged documents, half of them abusive where there are as many."""
    few = agreed.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    bad = few.filter("toxic > 0").orderBy("h").limit(most // 2)
    fine = few.filter("toxic <= 0").orderBy("h").limit(most - most // 2)
    picked = F.broadcast(bad.unionByName(fine).select("doc_id", "toxic"))
    return documents.select("doc_id", "text").join(picked, "doc_id").dropna(subset=["text"]).toPandas()


_STATE: dict = {}


def scored(documents: DataFrame, labels: DataFrame, keep: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The columns keep, the score and whether it reaches the threshold, of every document."""
    for name in ("score", "flagged"):
        if name in keep:
            raise ValueError(f"there is a column named {name} already")
    agreed = cut(agreed_labels(labels))
    sample = labelled_sample(documents, agreed, max_labelled).sort_values("doc_id")
    toxic = (sample["toxic"].to_numpy() > 0).astype(np.int64)
    if len(sample) == 0 or toxic.min() == toxic.max():
        return documents.select(*keep, F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    net, counts = train(sample["text"].tolist(), toxic)
    spark = documents.sparkSession
    shared = Shared(spark, net)
    columns = list(dict.fromkeys(["doc_id", *keep]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _STATE.get("key") != shared.key:
            _STATE.update(key=shared.key, net=shared.value, vocabulary=Vocabulary())
        for batch in batches:
            best = np.zeros(len(batch), np.float64)
            lo = 0
            texts = batch["text"].tolist()
            while lo < len(texts):
                if len(_STATE["vocabulary"].starts) > 60_000 or len(_STATE["vocabulary"].cells) > MOST_CELLS:
                    _STATE["vocabulary"] = Vocabulary()
                mats, owner, hi, size = [], [], lo, 0
                while hi < len(texts) and (hi == lo or size < 20_000):
                    m = window_matrix(_STATE["vocabulary"].add(words_of(texts[hi]))) if texts[hi] else None
                    if m is not None and len(m):
                        mats.append(m)
                        owner.append(np.full(len(m), hi))
                        size += len(m)
                    hi += 1
                if mats:
                    vocabulary = _STATE["vocabulary"].arrays()
                    np.maximum.at(best, np.concatenate(owner), score_windows(_STATE["net"], np.concatenate(mats), *vocabulary))
                lo = hi
            yield batch[columns].assign(score=best.round(6))

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "score double"])
    scores = cut(spread(documents.select(*columns, "text")).mapInPandas(run, schema))
    # The threshold follows from all judged documents that were not learnt from, as counts by score.
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"doc_id": sample["doc_id"], "counts": counts})))
    odds = F.log(F.greatest(F.col("score"), F.lit(1e-9)) / F.greatest(1 - F.col("score"), F.lit(1e-9)))
    reached = F.greatest(F.lit(0), F.least(F.lit(CUTS), F.floor((odds - FIRST_CUT) / CUT_STEP + 1e-6) + 1)).cast("int")
    judged = scores.select("doc_id", reached.alias("bin")).join(agreed, "doc_id").join(known, "doc_id", "left")
    bins = judged.groupBy("bin", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.sum(F.coalesce("counts", F.lit(1.0))).alias("n")).toPandas()
    limit = threshold(bins["bin"].to_numpy(), bins["toxic"].to_numpy(), bins["n"].to_numpy())
    return scores.select(*keep, "score", (F.col("score") >= limit).alias("flagged"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), ["doc_id", "source"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: documents with a passage that is abusive, hateful or sexually explicit."""
    return _scores(spark, sf_dir).filter("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_scores: the score of every document."""
    return _scores(spark, sf_dir).select("doc_id", "score", "flagged")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_rates: documents and flagged documents per source."""
    return (
        _scores(spark, sf_dir).groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg("score").alias("mean_score"))
        .withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
    )


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
