"""A convolutional text classifier for toxicity.

Lower-case words are hashed to embeddings; filters of one to three words slide over a text, each keeps its maximum, and a logistic layer weighs the
maxima. The network is fitted in numpy on a bounded sample of labelled rows, in one task. Embeddings start from the signed
likelihood ratio of a word between the classes, so that few epochs suffice. Thresholds are calibrated by language on rows left out of the fit; the
language is told from function words of the text itself, so a score depends on the text alone.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LAST, rows_of, text_or_empty, untag

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
FILTERS, DEPTH, EPOCHS, BATCH, RATE = 12, 12, 5, 64, 0.03
PAD = max(WIDTHS) - 1
SEGMENT = 200_000  # words scored at a time; longer texts go through in overlapping segments
POSITIVE_ROWS, NEGATIVE_ROWS, FIT_WORDS = 4000, 6000, 5000
_WORD = re.compile(r"\w+")

# Common function words by language.
LANGUAGES = {
    "en": "the and of to is that it for was are with this from have not be on as they you",
    "fr": "le la les des et que qui dans pour pas une est sur avec du au par plus ce il",
    "de": "der die das und ist nicht den von mit dem ein eine auf für zu im sich auch wird es",
    "es": "el los las que y una por con para del se su como más pero sus al lo es está",
}


def lexicon() -> dict[str, int]:
    """Function word -> language number from 1; words of several languages are left out."""
    seen: dict[str, set[int]] = {}
    for k, listed in enumerate(LANGUAGES.values(), 1):
        for w in listed.split():
            seen.setdefault(w, set()).add(k)
    return {w: next(iter(k)) for w, k in seen.items() if len(k) == 1}


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % BUCKETS


class Network:
    """``known`` are the buckets with an embedding, in order; row 0 is the zero vector of padding and unknown words."""

    def __init__(self, known: np.ndarray, embed: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.known, self.embed = known, embed.astype(np.float32)
        self.filters = [[rng.normal(0, 0.3 / np.sqrt(w * DEPTH), (DEPTH, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-1)
        for k, w in enumerate(WIDTHS):  # the first filter of a width reads the likelihood ratio
            for part in self.filters[k]:
                part[0, 0] = 1 / w
            self.out[k * FILTERS] = 1
        self.thresholds = np.zeros(len(LANGUAGES) + 1)

    def lay_out(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words with padding (-1) after each text, and where texts start."""
        pad = np.full(PAD, -1)
        parts = [p for t in texts for p in (t, pad)]
        sizes = np.array([len(t) + PAD for t in texts])
        return np.concatenate(parts), np.cumsum(sizes) - sizes

    def maxima(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Maxima of the windows that start at a word; one that reaches beyond its text sees zeros there."""
        padding = rows < 0
        x = self.embed[np.maximum(rows, 0)]
        pooled, maps = [], []
        for parts, bias in zip(self.filters, self.bias, strict=True):
            z = x @ parts[0]
            for k, part in enumerate(parts[1:], 1):
                z[:-k] += (x @ part)[k:]
            z += bias
            np.maximum(z, 0, out=z)
            z[padding] = 0
            maps.append(z)
            pooled.append(np.maximum.reduceat(z, starts))
        return np.concatenate(pooled, 1), maps, x

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts of any length: a long one goes through in segments, each of which sees the first words of the next."""
        best = np.zeros((len(texts), len(self.out)), np.float32)
        held: list[int] = []

        def flush():
            if held:
                best[held] = self.maxima(*self.lay_out([texts[i] for i in held]))[0]
                held.clear()

        size = 0
        for i, t in enumerate(texts):
            if len(t) > SEGMENT:
                whole = np.concatenate([t, np.full(PAD, -1)])
                for lo in range(0, len(t), SEGMENT):
                    _, maps, _ = self.maxima(whole[lo:lo + SEGMENT + PAD], np.zeros(1, np.int64))
                    best[i] = np.maximum(best[i], np.concatenate([z[:SEGMENT].max(0) for z in maps]))
                continue
            held.append(i)
            size += len(t)
            if size >= SEGMENT:
                flush()
                size = 0
        flush()
        return best @ self.out + self.base

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 6) -> None:
        """Gradient descent with per-weight step sizes (Adagrad) on the class-balanced logistic loss; half of the maxima are dropped at each step."""
        rng = np.random.default_rng(seed)
        sums = {"out": np.full_like(self.out, 0.1), "embed": np.full(len(self.embed), 0.1, np.float32),
                "filters": [[np.full_like(p, 0.1) for p in parts] for parts in self.filters], "bias": [np.full_like(b, 0.1) for b in self.bias]}
        base_sum = 0.1
        share = np.clip(labels.mean(), 0.02, 0.98)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                own = order[lo:lo + BATCH]
                rows, starts = self.lay_out([texts[i] for i in own])
                pooled, maps, x = self.maxima(rows, starts)
                keep = (rng.random(pooled.shape) < 0.5).astype(np.float32) * 2
                logit = (pooled * keep) @ self.out + self.base
                g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels[own]) * weight[own] / len(own)
                g = g.astype(np.float32)
                g_out = (pooled * keep).T @ g + 1e-4 * self.out
                g_pool = g[:, None] * self.out * keep * (pooled > 0)
                touched, moves = [], []
                ends = np.append(starts[1:], len(rows))
                for k, (parts, z) in enumerate(zip(self.filters, maps, strict=True)):
                    gp = g_pool[:, k * FILTERS:(k + 1) * FILTERS]
                    at = np.stack([z[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)])
                    for j, part in enumerate(parts):
                        where = np.minimum(at + j, len(rows) - 1)
                        grad = np.einsum("bf,bfd->df", gp, x[where]) + 1e-4 * part
                        touched.append(np.maximum(rows[where], 0).ravel())
                        moves.append((gp[:, :, None] * part.T[None]).reshape(-1, DEPTH))
                        sums["filters"][k][j] += grad * grad
                        part -= RATE * grad / np.sqrt(sums["filters"][k][j])
                    gb = gp.sum(0)
                    sums["bias"][k] += gb * gb
                    self.bias[k] -= RATE * gb / np.sqrt(sums["bias"][k])
                ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(ids), DEPTH), np.float32)
                np.add.at(grad, inverse, np.concatenate(moves))
                grad[ids == 0] = 0
                sums["embed"][ids] += (grad * grad).sum(1)
                self.embed[ids] -= RATE * grad / np.sqrt(sums["embed"][ids])[:, None]
                sums["out"] += g_out * g_out
                self.out -= RATE * g_out / np.sqrt(sums["out"])
                gc = g.sum()
                base_sum += gc * gc
                self.base -= np.float32(RATE * gc / np.sqrt(base_sum))

    def save(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"f{k}_{j}": p for k, parts in enumerate(self.filters) for j, p in enumerate(parts)} | {f"b{k}": b for k, b in enumerate(self.bias)}
        np.savez_compressed(out, known=self.known, embed=self.embed.astype(np.float16), out=self.out, base=self.base, thresholds=self.thresholds, **arrays)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Network:
        a = np.load(io.BytesIO(data))
        net = Network(a["known"], a["embed"])
        net.filters = [[a[f"f{k}_{j}"] for j in range(w)] for k, w in enumerate(WIDTHS)]
        net.bias, net.out, net.base, net.thresholds = [a[f"b{k}"] for k in range(len(WIDTHS))], a["out"], a["base"], a["thresholds"]
        return net


class _Rows(dict):
    """Word -> (its row of the embeddings, its language), packed into one number."""

    def __init__(self, net: Network):
        super().__init__()
        self.net, self.languages = net, lexicon()

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        b, known = bucket(word), self.net.known
        i = int(np.searchsorted(known, b))
        row = i + 1 if i < len(known) and known[i] == b else 0
        self[word] = found = row << 3 | self.languages.get(word, 0)
        return found

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """Rows of a text's words, and its language (0 if no function word tells)."""
        found = _WORD.findall(text.lower())
        packed = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        votes = np.bincount(packed & 7, minlength=len(LANGUAGES) + 1)[1:]
        return packed >> 3, int(votes.argmax()) + 1 if votes.any() else 0


def ratios(texts: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that two texts share, and the signed root of their likelihood ratio between the classes, less 3 (chance reaches that)."""
    at = [np.unique(np.fromiter(map(bucket, t), np.int64, len(t))) for t in (set(x) for x in texts)]
    flat, owner = np.concatenate(at), np.repeat(labels, [len(a) for a in at])
    known, inverse, total = np.unique(flat, return_inverse=True, return_counts=True)
    pos = np.bincount(inverse, weights=owner, minlength=len(known))
    rate, n1, n0 = labels.mean(), labels.sum(), len(labels) - labels.sum()
    neg = total - pos
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    g = 2 * (term(pos, total * rate) + term(neg, total * (1 - rate)) + term(n1 - pos, n1 - total * rate) + term(n0 - neg, n0 - total * (1 - rate)))
    score = np.sign(pos - total * rate) * np.maximum(np.sqrt(np.maximum(g, 0)) - 3, 0)
    some = total >= 2
    return known[some], score[some]


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap with the best F1."""
    order = np.argsort(-logits, kind="stable")
    s, hit = logits[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def train(texts: list[str], labels: np.ndarray, held: np.ndarray) -> Network:
    """Fit on the rows that are not held, calibrate thresholds on the held ones. With a class missing, every score is the share of label 1."""
    split = [_WORD.findall(t.lower()) for t in texts]
    own = np.flatnonzero(~held)
    if len(set(labels[own])) < 2:
        net = Network(np.zeros(0, np.int64), np.zeros((1, DEPTH)))
        share = np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99)
        net.out[:], net.base = 0, np.float32(np.log(share / (1 - share)))
        return net
    known, ratio = ratios([split[i] for i in own], labels[own].astype(float))
    rng = np.random.default_rng(4)
    embed = np.vstack([np.zeros(DEPTH), np.column_stack([ratio / 3, rng.normal(0, 0.05, (len(known), DEPTH - 1))])]) if len(known) else np.zeros((1, DEPTH))
    net = Network(known, embed)
    rows = _Rows(net)
    placed = [rows.of(t) for t in texts]
    net.fit([placed[i][0] for i in own], labels[own].astype(np.float32))
    ref = np.flatnonzero(held) if len(set(labels[held])) == 2 else own
    logits, said, tongue = net.logits([placed[i][0] for i in ref]), labels[ref], np.array([placed[i][1] for i in ref])
    pooled = best_threshold(logits, said)
    for k in range(len(net.thresholds)):
        here = tongue == k
        n = int(min(said[here].sum(), (1 - said[here]).sum()))
        net.thresholds[k] = (n * best_threshold(logits[here], said[here]) + 20 * pooled) / (n + 20) if n >= 5 else pooled
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        positive_rows: int = POSITIVE_ROWS, negative_rows: int = NEGATIVE_ROWS) -> bytes:
    """Fit a network on at most ``positive_rows`` and ``negative_rows`` labelled rows, picked by a hash of the id, of up to ``FIT_WORDS`` words each.

    A quarter of them calibrates the thresholds. Rows with a null id or label don't count; if an id has several labels, 1 wins. The sample is bounded
    whatever the tables hold, so it is broadcast to the documents, and fitted in one task; the driver receives the model only.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.withColumn("order", F.xxhash64("id", F.lit(3)))
    picked = [known.filter(F.col("label") == v).orderBy("order", "id").limit(n) for v, n in ((1, positive_rows), (0, negative_rows))]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(sample, "id")
    rows = rows.filter(F.length(F.regexp_replace("text", r"\S+", "")) <= FIT_WORDS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text"])
        held = np.array([zlib.crc32(b"%d calibrate" % i) % 4 == 0 for i in pdf["id"]], bool)
        return pd.DataFrame({"model": [train(pdf["text"].tolist(), pdf["label"].to_numpy(), held).save()]})

    found = rows.groupBy(F.lit(1).alias("_one")).applyInPandas(run, "model binary").collect()
    return bytes(found[0].model) if found else train([], np.zeros(0), np.zeros(0, bool)).save()


_LOADED: dict[bytes, _Rows] = {}


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]):
        key = xxhash.xxh3_128_digest(model.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _Rows(Network.load(model.value))
        rows = _LOADED[key]
        names = ["", *LANGUAGES]
        for b in batches:
            ids, texts, tongues = [], [], []
            for id_, text in rows_of(iter([b]), "id", "text"):
                found, k = rows.of(text)
                ids.append(id_)
                texts.append(found)
                tongues.append(k)
            margin = rows.net.logits(texts).astype(float) - rows.net.thresholds[tongues] if ids else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array([names[k] for k in tongues], pa.string())], names=["id", "score", "language"])

    return run


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, language`` of every whole text: at 0.5 the score crosses the threshold of the text's language.

    The model has some MB, bounded by the sample it was fitted on. Null and empty texts have the score of a text without words; tied, repeated and null
    ids pass through; other columns are ignored; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_score(held), "id long, score double, language string").select(untag("id").alias(id_col), "score", "language")
