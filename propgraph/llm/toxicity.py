"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is read as a learned vector of its hashed form and the mean of learned vectors of its
hashed character 3- to 5-grams, so unseen forms of known stems are recognised. A window of 32 words
goes through a forward and a backward gated recurrent layer; attention weighs the steps and the
pooled state gives a logit. Windows start every 24 words, so they overlap and cover the whole text;
a text scores as its worst window. Training sees only the text's label: the window that carries a
positive label is first the one with the most telling n-grams, then the one the network itself
scores highest.

The fit runs on the driver on a bounded sample of labelled rows, whole texts of them: those of least
crc32 of the id, at most ``SAMPLE``, passing over rows that would take the sample over ``CHARACTERS``
in all. Rows of one id, label and text count once; ties in the crc32 go by id, label and digest, so
the same tables give the same network. Fewer rows are gone through more often (6 to 20 times).
Scoring runs on all rows and whole texts, in batches of bounded size. Null and empty texts score the
share of positive labels; so does every text if the labels hold one class only, or 0 without labels.
Repeated rows score alike, an empty table gives no rows, and columns besides id and text are not
looked at; ``reject`` returns them as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, lean, tidy

SPAN, STRIDE = 32, 24
HIDDEN, ATTENTION = 8, 8
WORD_BITS, WORD_SIZE = 14, 8
CHAR_BITS, CHAR_SIZE = 15, 12
GRAMS = (3, 4, 5)
SAMPLE = 8000
CHARACTERS = 16_000_000
BATCH_WORDS = 100_000
BATCH_WINDOWS = 1024
#: Distinct words whose n-grams are looked at together.
PART = 20_000
FOLDS, FOLD = 5, 0

_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all n-grams; how many of these each word has."""
    data = [b"<" + w.encode() + b">" for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(flat))
    place = np.arange(len(flat)) - (ends - lengths)[owner]
    whole = np.add.reduceat(flat * (_POWERS[np.minimum(place, len(_POWERS) - 1)]), ends - lengths, dtype=np.uint32) if len(words) else np.zeros(0, np.uint32)
    word = (whole * np.uint32(2654435761)) >> np.uint32(32 - WORD_BITS)
    rows, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + flat[at + k]
        rows.append((h * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS))
        owners.append(owner[at])
    gram, owned = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    return word.astype(np.int32), gram[order].astype(np.int32), np.bincount(owned, minlength=len(words))


_POWERS = np.cumprod(np.full(4096, 0x01000193, np.uint32), dtype=np.uint32)


def windows_of(n: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``n`` words."""
    last = max(0, -(-(n - SPAN) // STRIDE))
    return [(i * STRIDE, min(n, i * STRIDE + SPAN)) for i in range(last + 1)] if n else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """The network's arrays; both directions lie side by side in the first axis of ``u`` and the last of ``w``."""

    prior: float = 0.0
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(prior: float, seed: int = 4) -> Net:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        wide, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        return Net(
            prior,
            {
                "word": normal(1 << WORD_BITS, WORD_SIZE, scale=0.05),
                "char": normal(1 << CHAR_BITS, CHAR_SIZE, scale=0.1),
                "w": normal(wide, 6 * h, scale=0.5),
                "b": np.zeros(6 * h, np.float32),
                "u": normal(2, h, 3 * h, scale=0.3),
                "a": normal(2 * h, ATTENTION, scale=0.3),
                "v": normal(ATTENTION, scale=0.3),
                "o": normal(2 * h, scale=0.3),
                "c": np.full(1, np.log(max(prior, 1e-3)), np.float32),
            },
        )

    def inputs(self, word: np.ndarray, gram: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        p = self.p
        out = np.empty((len(word), WORD_SIZE + CHAR_SIZE), np.float32)
        out[:, :WORD_SIZE] = p["word"][word]
        ends = np.cumsum(has)
        for a in range(0, len(word), PART):
            b = min(len(word), a + PART)
            begin = ends[a] - has[a]
            sums = np.add.reduceat(p["char"][gram[begin : ends[b - 1]]], ends[a:b] - has[a:b] - begin, axis=0)
            out[a:b, WORD_SIZE:] = sums / has[a:b, None]
        return out

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of each distinct word, and a last row of zeros for padding; directions first."""
        w, b, wide = self.p["w"], self.p["b"], 3 * HIDDEN
        g = np.zeros((2, len(x) + 1, wide), x.dtype)
        for side in (0, 1):
            np.matmul(x, w[:, side * wide : (side + 1) * wide], out=g[side, :-1])
            g[side, :-1] += b[side * wide : (side + 1) * wide]
        return g

    def forward(self, g: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (steps x windows of rows of ``g``; the last row pads)."""
        p, h = self.p, HIDDEN
        span, many = at.shape
        pad = g.shape[1] - 1
        real = (at != pad).astype(np.float32)
        state = np.zeros((2, many, h), np.float32)
        states = np.empty((span, 2, many, h), np.float32)
        memory = []
        for t in range(span):
            back = span - 1 - t
            x = np.stack([g[0, at[t]], g[1, at[back]]])
            m = np.stack([real[t], real[back]])[:, :, None]
            hu = state @ p["u"]
            zr = sigmoid(x[..., : 2 * h] + hu[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * hu[..., 2 * h :])
            new = n + z * (state - n)
            if keep:
                memory.append((state, z, r, n, hu[..., 2 * h :], m))
            state = state + m * (new - state)
            states[t, 0], states[back, 1] = state[0], state[1]
        both = states.transpose(0, 2, 1, 3).reshape(span, many, 2 * h)
        hidden = np.tanh(both @ p["a"])
        score = hidden @ p["v"] + (real - 1) * 1e4
        score = np.exp(score - score.max(axis=0))
        alpha = score / score.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", alpha, both)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (memory, both, hidden, alpha, pooled)) if keep else logit

    def backward(self, g: np.ndarray, at: np.ndarray, d: np.ndarray, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the recurrent part and of the gate inputs, from those of the logits."""
        p, h = self.p, HIDDEN
        memory, both, hidden, alpha, pooled = saved
        span, many = at.shape
        grad = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["o"]
        d_alpha = np.einsum("bh,tbh->tb", d_pooled, both)
        d_both = alpha[:, :, None] * d_pooled
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["v"] = np.einsum("tba,tb->a", hidden, d_score)
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        grad["a"] = np.einsum("tbh,tba->ha", both, d_hidden)
        d_both = d_both + d_hidden @ p["a"].T
        d_states = d_both.reshape(span, many, 2, h).transpose(0, 2, 1, 3)
        grad["u"] = np.zeros_like(p["u"])
        d_g = np.zeros_like(g)
        d_state = np.zeros((2, many, h), np.float32)
        for t in range(span - 1, -1, -1):
            back = span - 1 - t
            state, z, r, n, hu_n, m = memory[t]
            d_state = d_state + np.stack([d_states[t, 0], d_states[back, 1]])
            d_new = d_state * m
            d_n = d_new * (1 - z) * (1 - n**2)
            d_z = d_new * (state - n) * z * (1 - z)
            d_r = d_n * hu_n * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_n], axis=2)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=2)
            grad["u"] += state.transpose(0, 2, 1) @ d_hu
            d_state = d_state * (1 - m) + d_new * z + d_hu @ p["u"].transpose(0, 2, 1)
            np.add.at(d_g[0], at[t], d_x[0])
            np.add.at(d_g[1], at[back], d_x[1])
        return grad, d_g[:, :-1]


class Texts:
    """Texts as windows over their distinct words. Takes words text by text, so no list of all words is held."""

    def __init__(self, texts: Iterable[list[str]]):
        known: dict[str, int] = {}
        number = known.setdefault
        codes, rows, owner, begin = [], [], [], 0
        for i, t in enumerate(texts):
            codes.append(np.array([number(w, len(known)) for w in t], np.int32))
            for a, b in windows_of(len(t)):
                rows.append((begin + a, begin + b))
                owner.append(i)
            begin += len(t)
        self.owner = np.array(owner, np.int64)
        words = list(known)
        parts = [grams_of(words[i : i + PART]) for i in range(0, len(words), PART)] or [grams_of([])]
        self.word, self.gram, self.has = (np.concatenate(x) for x in zip(*parts))
        pad = len(words)
        if rows:
            flat = np.append(np.concatenate(codes), np.int32(pad))
            spans = np.array(rows)
            self.at = np.empty((SPAN, len(rows)), np.int32)
            for k in range(SPAN):
                place = spans[:, 0] + k
                self.at[k] = np.where(place < spans[:, 1], flat[np.minimum(place, begin)], pad)
        else:
            self.at = np.zeros((SPAN, 0), np.int32)


def window_logits(net: Net, t: Texts) -> np.ndarray:
    g = net.steps(net.inputs(t.word, t.gram, t.has))
    parts = [net.forward(g, t.at[:, i : i + BATCH_WINDOWS]) for i in range(0, t.at.shape[1], BATCH_WINDOWS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """Score of each text: that of its worst window."""
    out = np.full(len(texts), net.prior)
    if not net.p:
        return out
    at = 0
    while at < len(texts):
        own: list[list[str]] = []
        n = 0
        while at + len(own) < len(texts) and n < BATCH_WORDS:  # words of a few texts at a time
            own.append(tokens(texts[at + len(own)]))
            n += len(own[-1])
        t = Texts(own)
        if len(t.owner):
            worst = np.full(len(own), -np.inf)
            np.maximum.at(worst, t.owner, window_logits(net, t).astype(np.float64))
            some = np.isfinite(worst)
            out[at : at + len(own)][some] = sigmoid(worst[some])
        at += len(own)
    return np.clip(out, 0.0, 1.0)


def train(texts: list[str | None], labels: list[int], seed: int = 4) -> Net:
    """Fit the network; only order and seed decide."""
    y = np.array(labels, np.float32)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or prior in (0.0, 1.0):
        return Net(prior)
    rng = np.random.default_rng(seed)
    t = Texts(map(tokens, texts))
    if not len(t.owner):
        return Net(prior)
    net = Net.fresh(prior, seed)
    lead = _telling(t, y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    updates = 0
    positive = y[t.owner] > 0
    epochs = int(np.clip(24_000 // len(y), 6, 20))
    for epoch in range(epochs):
        order = np.lexsort((-lead, t.owner))
        top = order[np.r_[True, t.owner[order][1:] != t.owner[order][:-1]]]
        spare = np.flatnonzero(~positive)
        spare = rng.choice(spare, min(len(spare), len(y)), replace=False) if len(spare) else spare
        batch = rng.permutation(np.concatenate([top, spare]))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(batch), 128):
            updates += 1
            _update(net, t, batch[i : i + 128], y, moments, updates, rate, rng)
        lead = window_logits(net, t)
    return net


def _telling(t: Texts, y: np.ndarray) -> np.ndarray:
    """Of each window the largest log-odds of an n-gram, by documents with and without it."""
    begin = np.cumsum(t.has) - t.has
    owner_of_word = np.repeat(np.arange(len(t.has), dtype=np.int32), t.has)
    wide = len(t.has) + 1
    both = np.unique(np.repeat(t.owner, SPAN) * wide + t.at.T.ravel())
    pairs = np.stack([both // wide, both % wide])
    pairs = pairs[:, pairs[1] < len(t.has)]
    with_, without = np.zeros(1 << CHAR_BITS), np.zeros(1 << CHAR_BITS)
    share = y.mean()
    for count, own in ((with_, y[pairs[0]] > 0), (without, y[pairs[0]] <= 0)):
        words = np.bincount(pairs[1][own], minlength=len(t.has))
        np.add.at(count, t.gram, words[owner_of_word])
    odds = np.log((with_ + 0.5) / share) - np.log((without + 0.5) / (1 - share))
    best = np.append(np.maximum.reduceat(odds[t.gram], begin), -np.inf) if len(begin) else np.array([-np.inf])
    return best[t.at].max(axis=0)


def _update(net: Net, t: Texts, chosen: np.ndarray, y: np.ndarray, moments: dict, step: int, rate: float, rng: np.random.Generator) -> None:
    used, local = np.unique(t.at[:, chosen], return_inverse=True)
    local = local.reshape(SPAN, len(chosen))
    pad = len(t.has)
    if used[-1] == pad:
        used = used[:-1]
    begin = np.cumsum(t.has) - t.has
    has = t.has[used]
    pick = np.repeat(begin[used] - (np.cumsum(has) - has), has) + np.arange(int(has.sum()))
    word, gram = t.word[used], t.gram[pick]
    x = net.inputs(word, gram, has)
    drop = rng.random(len(x)) < 0.6  # hides the word's own vector, so its characters must do
    x[drop, :WORD_SIZE] = 0
    g = net.steps(x)
    logit, saved = net.forward(g, local, keep=True)
    d = ((sigmoid(logit) - y[t.owner[chosen]]) / len(chosen)).astype(np.float32)
    grad, d_g = net.backward(g, local, d, saved)
    d_g = d_g.transpose(1, 0, 2).reshape(len(x), -1)
    grad["w"], grad["b"] = x.T @ d_g, d_g.sum(axis=0)
    d_x = d_g @ net.p["w"].T
    d_x[drop, :WORD_SIZE] = 0
    grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(grad["word"], word, d_x[:, :WORD_SIZE])
    np.add.at(grad["char"], gram, np.repeat(d_x[:, WORD_SIZE:] / has[:, None], has, axis=0).astype(np.float32))
    for k, value in net.p.items():
        m, v = moments[k]
        m += 0.1 * (grad[k] - m)
        v += 0.001 * (grad[k] ** 2 - v)
        value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows outside the held-out fold, of the at most ``most`` labels of least crc32 of the id: ``doc_id, text, y, order, digest``."""
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    own = own.filter(~held_out(F.col("id"), folds, fold)).withColumn("order", F.crc32(F.col("id").cast("string")))
    own = own.orderBy("order", "id", "y").limit(most)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("id"))  # at most ``most`` rows
    return rows.select("doc_id", "text", "y", "order", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, characters: int = CHARACTERS, doc_id: str = "doc_id", text: str = "text") -> Net:
    """The network fitted to ``labels.toxic``. First only lengths reach the driver, then the texts of the sample."""
    rows = sample(docs, labels, "toxic", FOLDS, FOLD, most, doc_id, text)
    key = ["order", "doc_id", "y", "digest"]
    sizes = rows.select(*key, F.length(F.coalesce("text", F.lit(""))).alias("size")).distinct().orderBy(*key).limit(most).collect()
    chosen, held = [], 0
    for r in sizes:
        if held + r["size"] <= characters:
            chosen.append((r["doc_id"], r["y"], r["digest"]))
            held += r["size"]
    schema = T.StructType([T.StructField("own_id", docs.schema[doc_id].dataType), T.StructField("own_y", T.IntegerType()), T.StructField("own_digest", T.StringType())])
    own = F.broadcast(docs.sparkSession.createDataFrame(chosen, schema))  # at most ``most`` rows
    texts = rows.join(own, (F.col("doc_id") == F.col("own_id")) & (F.col("y") == F.col("own_y")) & (F.col("digest") == F.col("own_digest")), "left_semi")
    taken = texts.dropDuplicates(key).orderBy(*key).limit(most).select("text", "y").toPandas()
    net = train(taken["text"].tolist(), [int(v > 0) for v in taken["y"]])
    del taken
    tidy()
    return net


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(doc_id, text).mapInArrow(lean(run), f"doc_id {kind}, score double")


def reject(docs: DataFrame, net: Net, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns and order of columns as they were."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(net, batch.column(place).to_pylist()) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
