"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Documents are labelled, tokens aren't: tokens of the training documents get labels from a small set of features
(words, or prefixes of words) that explain the toxic documents and occur in almost no clean one, chosen greedily by
how many yet unexplained toxic documents they add. On these labelled tokens a chain with two labels is trained:
hashed emissions (word, prefixes of 3 to 6 bytes, neighbours enter through the chain) and transitions, by gradient on
the exact likelihood.

Every whole document is then tagged: forward and backward messages are computed for all documents of a batch at once
by a blocked scan over 2 x 2 matrices. A document's score is its largest marginal of the label "toxic"; spans are
runs of tokens whose marginal gets to 0.5, with character offsets.

Training reads a bounded, documented sample: at most about `most` documents of each label, and of them `windows` windows of
`width` tokens at most: up to 4 around labelled tokens of a toxic document, 2 anywhere in a clean one. (Which features
label tokens is decided on the whole texts of the sample.) Scoring reads whole texts.

Nulls and edge cases: a null or empty text has no tokens and gets score 0; labels that are null aren't used; without
any toxic (or any clean) training document every score is 0; repeated rows are scored each; columns beside doc_id
and text are no inputs and keep their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_BYTES, Memo, bounded_sample, word_bytes

BUCKETS = 1 << 16
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(rb"\S+")


def token_features(word: bytes) -> list[bytes]:
    return [b"w" + word, *(b"p" + word[:n] for n in PREFIXES if len(word) > n)]


def buckets_of(word: bytes) -> list[int]:
    return [zlib.crc32(f) % BUCKETS for f in token_features(word)]


@dataclass
class Crf:
    weights: np.ndarray  # emission of label 1 against label 0
    bias: float
    trans: np.ndarray  # 2 x 2, by (from, to)
    start: np.ndarray  # 2
    trained: bool = True


def marks_of(word: bytes) -> list[int]:
    """A token's features as numbers; the last three bits tell a word (7) from prefixes (their length)."""
    return [zlib.crc32(f) & ~7 | (7 if f[:1] == b"w" else len(f) - 1) for f in token_features(word)]


def explain(toxic: list[np.ndarray], clean: list[np.ndarray], least: int = 3) -> set[int]:
    """Features that cover the toxic documents: each adds at least `least` documents (or 1 in 200 of them).

    A document is the array of its distinct features. Candidates occur in toxic documents far above what chance gives
    for features of clean ones (log-likelihood ratio, and at most 1 in 500 of the clean documents).
    """
    if not toxic or not clean:
        return set()
    n1, n0 = len(toxic), len(clean)
    least = max(least, n1 // 200)
    known, inside = np.unique(np.concatenate(toxic), return_counts=True)
    known, inside = known[inside >= least], inside[inside >= least]
    outside = np.zeros(len(known), np.int64)
    for d in clean:
        at = np.searchsorted(known, d)
        at = at[at < len(known)]
        outside += np.bincount(at[known[at] == d[: len(at)]], minlength=len(known)) if len(known) else 0

    def surprise(a: int, b: int) -> float:
        """Twice the log-likelihood ratio of a in n1 against b in n0."""
        p = (a + b) / (n1 + n0)
        return 2 * sum(x * math.log(x / (n * q)) for x, n, q in ((a, n1, p), (b, n0, p), (n1 - a, n1, 1 - p), (n0 - b, n0, 1 - p)) if x > 0 and n * q > 0)

    counts = {f: (a, b) for f, a, b in zip(known.tolist(), inside.tolist(), outside.tolist(), strict=True) if b <= n0 / 500 and surprise(a, b) >= 6}
    good = np.array(sorted(counts), known.dtype)
    own = [np.intersect1d(d, good, assume_unique=True).tolist() for d in toxic]
    where: dict[int, set[int]] = {}
    for i, fs in enumerate(own):
        for f in fs:
            where.setdefault(f, set()).add(i)
    chosen: set[int] = set()
    while where:
        # more documents first; of equals whole words, then longer prefixes
        f = max(where, key=lambda f: (len(where[f]), f & 7, f))
        done = where.pop(f)
        if len(done) < least:
            break
        chosen.add(f)
        where = {g: left for g, w in where.items() if (left := w - done)}
    # what these documents also hold, and no clean one, on strong evidence
    explained = Counter(f for fs in own if chosen.intersection(fs) for f in fs)
    return chosen | {f for f, (a, b) in counts.items() if not b and explained[f] >= least and surprise(a, 0) >= 20}


def distinct_documents(docs: list[list[bytes]]) -> list[list[bytes]]:
    """Without near copies, whose words would pass for evidence: documents that share one of their two least shingles."""
    seen: set[int] = set()
    out = []
    for d in docs:
        least = sorted({zlib.crc32(b" ".join(d[i : i + 5])) for i in range(max(1, len(d) - 4))})[:2]
        if not seen.intersection(least):
            out.append(d)
        seen.update(least)
    return out


def _forward_backward(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple:
    """Log partition, marginals of label 1, expected transitions and starts of padded sequences (rows of e)."""
    rows, most = e.shape
    t = np.exp(trans)
    alpha = np.zeros((most, rows, 2))
    norm = np.zeros((most, rows))
    emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], -1)
    a = np.exp(start)[None, :] * emit[:, 0]
    for i in range(most):
        if i:
            a = (alpha[i - 1] @ t) * emit[:, i]
        norm[i] = a.sum(1)
        alpha[i] = a / norm[i][:, None]
    live = np.arange(most)[:, None] < lens[None, :]
    beta = np.ones((rows, 2))
    p, pairs = np.zeros((most, rows)), np.zeros((2, 2))
    for i in range(most - 1, -1, -1):
        if i < most - 1:
            follows = live[i + 1]
            step = emit[:, i + 1] * beta / norm[i + 1][:, None]
            pairs += np.einsum("ra,ab,rb->ab", alpha[i] * follows[:, None], t, step)
            beta = np.where(follows[:, None], step @ t.T, 1.0)
        g = alpha[i] * beta
        p[i] = g[:, 1] / g.sum(1)
    return (np.log(norm) * live).sum(), (p * live).T, pairs, np.array([(1 - p[0]).sum(), p[0].sum()])


def train_crf(sequences: list[list[bytes]], labels: list[list[int]], steps: int = 80, rate: float = 0.4, l2: float = 0.02) -> Crf:
    """Adagrad on the exact likelihood of all sequences at once."""
    most, n = max(map(len, sequences)), len(sequences)
    lens = np.array([len(s) for s in sequences])
    y = np.zeros((n, most), int)
    for i, l in enumerate(labels):
        y[i, : len(l)] = l
    live = np.arange(most)[None, :] < lens[:, None]
    memo: dict[bytes, list[int]] = {}
    cols, cell = [], []
    for i, s in enumerate(sequences):
        for j, w in enumerate(s):
            f = memo.get(w) or memo.setdefault(w, buckets_of(w))
            cols.extend(f)
            cell.extend([i * most + j] * len(f))
    used, local = np.unique(np.array(cols), return_inverse=True)
    cell = np.array(cell)
    both = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    first = np.bincount(y[:, 0], minlength=2)
    flat_y = (y * live).ravel()
    w, bias, trans, start = np.zeros(len(used)), -2.0, np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(len(used), 1e-6), 1e-6, np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    for _ in range(steps):
        e = (np.bincount(cell, w[local], minlength=n * most) + bias).reshape(n, most)
        _, p, pairs, starts = _forward_backward(e, lens, trans, start)
        gap = p.ravel() - flat_y
        grads = [np.bincount(local, gap[cell], minlength=len(used)) + l2 * w, gap.sum(), pairs - seen + l2 * trans, starts - first + l2 * start]
        for k, g in enumerate(grads):
            sums[k] = sums[k] + g * g
        w, bias, trans, start = (x - rate * g / np.sqrt(s) for x, g, s in zip((w, bias, trans, start), grads, sums, strict=True))
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Crf(weights, float(bias), trans, start)


def train(toxic: list[list[bytes]], clean: list[list[bytes]], width: int = 48, windows: int = 5000) -> Crf:
    """toxic, clean: words of the training documents of either label."""
    toxic, clean = distinct_documents(toxic), distinct_documents(clean)
    marks = Memo(marks_of, 100_000)
    of = lambda d: np.unique(np.array([f for w in set(d) for f in marks[w]], np.int64))
    chosen = explain([of(d) for d in toxic], [of(d) for d in clean])
    if not chosen or not clean:
        return Crf(np.zeros(BUCKETS), -40.0, np.zeros((2, 2)), np.zeros(2), False)
    bad = Memo(lambda w: int(any(f in chosen for f in marks_of(w))), 100_000)
    rng = np.random.default_rng(7)
    sequences, labels = [], []
    for d in toxic:
        tags = [bad[w] for w in d]
        hits = [i for i, t in enumerate(tags) if t]
        for i in hits[:: max(1, len(hits) // 4)][:4]:
            a = max(0, i - int(rng.integers(0, width)))
            sequences.append(d[a : a + width])
            labels.append(tags[a : a + width])
    for d in clean:
        for a in rng.integers(0, max(1, len(d) - width + 1), 2) if d else ():
            sequences.append(d[a : a + width])
            labels.append([0] * len(sequences[-1]))
    pick = rng.permutation(len(sequences))[:windows]
    return train_crf([sequences[i] for i in pick], [labels[i] for i in pick])


def marginals(e: np.ndarray, firsts: np.ndarray, model: Crf, block: int = 64) -> np.ndarray:
    """Marginal of label 1 at each token of concatenated sequences; firsts: where they begin. Exact, in blocks."""
    n = len(e)
    size = -(-n // block) * block
    t, begin = np.exp(model.trans), np.zeros(size, bool)
    begin[firsts] = True
    begin[n:] = True  # padding is made of sequences of its own
    x = np.zeros(size)
    x[:n] = np.clip(e, -40, 40)
    emit = np.exp(x)
    lead = np.exp(model.start)
    # a token's matrix maps the message before it to the message after it; a first token forgets what came before
    m = np.empty((4, size))
    for a in (0, 1):
        m[2 * a] = np.where(begin, lead[0], t[a, 0])
        m[2 * a + 1] = np.where(begin, lead[1], t[a, 1]) * emit
    m = m.reshape(4, -1, block)

    def scan(parts: list[np.ndarray], order: range) -> np.ndarray:
        """Products of matrices from a block's edge up to each place, scaled: (4, blocks, block)."""
        out = np.empty((4, *parts[0].shape))
        for k, i in enumerate(order):
            if k:
                p = out[:, :, order[k - 1]]
                a, b, c, d = (q[:, i] for q in parts)
                now = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
            else:
                now = np.stack([q[:, i] for q in parts])
            out[:, :, i] = now / now.max(0)
        return out

    ahead = scan([m[k] for k in range(4)], range(block))
    blocks = m.shape[1]
    v, enter = np.array([0.5, 0.5]), np.empty((blocks, 2))
    last = ahead[:, :, -1].T.tolist()
    p0, p1 = 0.5, 0.5
    for k, (a, b, c, d) in enumerate(last):
        enter[k] = p0, p1
        p0, p1 = p0 * a + p1 * c, p0 * b + p1 * d
        s = p0 + p1
        p0, p1 = p0 / s, p1 / s
    v = enter.T[:, :, None]
    alpha = np.stack([v[0] * ahead[0] + v[1] * ahead[2], v[0] * ahead[1] + v[1] * ahead[3]]).reshape(2, size)
    # backward: the message that follows a token comes through the next token's matrix, transposed; none follows a last token
    after = np.concatenate([begin[1:], [True]])
    nxt = np.empty((4, size))
    flat = m.reshape(4, size)
    shifted = np.concatenate([flat[:, 1:], np.ones((4, 1))], 1)
    for k, j in enumerate((0, 2, 1, 3)):  # transposed
        nxt[k] = np.where(after, 1.0, shifted[j])
    nxt = nxt.reshape(4, -1, block)
    behind = scan([nxt[k] for k in range(4)], range(block - 1, -1, -1))
    q0, q1, enter = 0.5, 0.5, np.empty((blocks, 2))
    firsts_of = behind[:, :, 0].T.tolist()
    for k in range(blocks - 1, -1, -1):
        a, b, c, d = firsts_of[k]
        enter[k] = q0, q1
        q0, q1 = q0 * a + q1 * c, q0 * b + q1 * d
        s = q0 + q1
        q0, q1 = q0 / s, q1 / s
    u = enter.T[:, :, None]
    beta = np.stack([u[0] * behind[0] + u[1] * behind[2], u[0] * behind[1] + u[1] * behind[3]]).reshape(2, size)
    g = alpha * beta
    return (g[1] / (g[0] + g[1]))[:n]


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of tokens whose marginal gets to `least`, by character offsets [start, end)."""
    raw = text.encode("utf-8", "replace")
    out: list[dict] = []
    bounds = [m.span() for m in _WORD.finditer(raw.translate(WORD_BYTES))]
    for i in np.flatnonzero(p >= least).tolist():
        a, b = bounds[i]
        if out and out[-1]["token"] == i - 1:
            out[-1].update(byte=b, token=i, p=max(out[-1]["p"], float(p[i])))
        else:
            out.append({"from": a, "byte": b, "token": i, "p": float(p[i])})
    at = chars = 0
    done = []
    for s in out:  # bytes to characters, in one pass
        chars += len(raw[at : s["from"]].decode("utf-8", "ignore"))
        width = len(raw[s["from"] : s["byte"]].decode("utf-8", "ignore"))
        done.append({"start": chars, "end": chars + width, "p": s["p"]})
        chars, at = chars + width, s["byte"]
    return done


TAGGED = "score double, n_spans int, spans array<struct<start:int,end:int,p:double>>"


def tagger(model: Crf):
    """A pandas UDF text -> (score, n_spans, spans)."""
    used = np.flatnonzero(model.weights)
    sent, values, rest = used.astype(np.int32), model.weights[used].astype(np.float32), Crf(np.zeros(0), model.bias, model.trans, model.start, model.trained)

    @F.pandas_udf(TAGGED)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = np.zeros(BUCKETS)
        w[sent] = values
        emission = Memo(lambda word: float(w[buckets_of(word)].sum()) + rest.bias)
        for texts in batches:
            score, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            at = 0
            while at < len(texts) and rest.trained:
                flat, firsts, owner = [], [], []
                while at < len(texts) and len(flat) < 300_000:  # whole documents, about this many tokens at once
                    words = word_bytes(texts.iloc[at])
                    if words:
                        firsts.append(len(flat))
                        owner.append(at)
                        flat += [emission[x] for x in words]
                    at += 1
                if not flat:
                    continue
                p = marginals(np.array(flat), np.array(firsts), rest)
                best = np.maximum.reduceat(p, firsts)
                for k, i in enumerate(owner):
                    score[i] = best[k]
                    if best[k] >= 0.5:
                        spans[i] = spans_of(texts.iloc[i], p[firsts[k] : firsts[k + 1] if k + 1 < len(firsts) else None])
            yield pd.DataFrame({"score": score, "n_spans": np.array([len(s) for s in spans], np.int32), "spans": spans})

    return tag


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, width: int = 48, windows: int = 5000) -> Crf:
    """docs: doc_id, text; labels: doc_id, toxic. At most about `most` documents of each label are read, and at most
    `windows` windows of `width` tokens from them trained on.

    The sample is drawn from the labels; its ids are few and find their texts without a shuffle.
    """
    words = {}
    for label in (1, 0):
        ids = bounded_sample(labels.filter(F.col("toxic") == label).select("doc_id"), "doc_id", most)
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
        words[label] = [word_bytes(r.text) for r in rows.select("text").toLocalIterator()]
    return train(words[1], words[0], width, windows)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, score, n_spans, spans of each whole text."""
    s = docs.select("doc_id", tagger(model)(F.col("text").cast("string")).alias("s"))
    return s.select("doc_id", "s.score", "s.n_spans", "s.spans")


def keep_clean(docs: DataFrame, model: Crf, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with their own columns, whose score stays below `threshold`."""
    columns = docs.columns
    mark = "__tessera_toxicity"
    return docs.withColumn(mark, tagger(model)(F.col("text").cast("string"))).filter(F.col(f"{mark}.score") < threshold).select(*[f"`{c}`" for c in columns])
