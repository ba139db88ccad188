"""Toxicity by a linear-chain conditional random field.

Labels mark documents; tokens are labelled from them: a word is a cue when documents labelled toxic hold it
significantly more often than clean ones, and cue words inside toxic documents carry the tag T, all other tokens O.
A two-state chain (word emissions, transitions) is trained on these tags by maximum likelihood. Its forward-backward
marginals give each document its expected and largest toxicity, which a logistic layer turns into the score, and each
token's marginal marks the offending offsets. Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from, a
sample of at most MAX_DOCS of them; every text is scored whole.

Null texts count as empty and get the score of a text without cues; null doc_ids are scored and never learnt from;
repeated rows score alike; without labelled rows of both classes every score is the share of toxic ones (0 without
rows); extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import text_column

#: Bound of the labelled sample, and of the part of it that trains the chain.
MAX_DOCS, MAX_CHAIN_DOCS = 5000, 800
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    vocabulary: dict[str, int] = field(default_factory=dict)
    emission: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of T against O; 0 for words without an entry
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = 0.0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts in a row, and the number of words of each."""
        get, out, lengths = self.vocabulary.get, [], []
        for t in texts:
            found = words(t)
            out += [get(w, 0) for w in found]
            lengths.append(len(found))
        return np.asarray(out, np.int32), np.asarray(lengths, np.int64)

    def marginals(self, ids: np.ndarray, first: np.ndarray, want_pairs: bool = False):
        """P(T) of every token by forward-backward. first marks the first token of a document.

        All documents form one chain that restarts at each first token (a matrix of rank one forgets what came
        before), so the recursions run over blocks of the chain side by side.
        """
        n = len(ids)
        psi = np.exp(np.clip(self.emission[ids], -30, 30))
        a = np.exp(self.transition)
        s = np.exp(self.start)
        m = np.empty((4, n))  # m00 m01 m10 m11
        m[0], m[1] = np.where(first, s[0], a[0, 0]), np.where(first, s[1], a[0, 1]) * psi
        m[2], m[3] = np.where(first, s[0], a[1, 0]), np.where(first, s[1], a[1, 1]) * psi
        width = max(1, int(np.sqrt(n)))
        rows = -(-n // width)
        pad = rows * width - n
        if pad:
            m = np.concatenate([m, np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), pad, axis=1)], axis=1)
        m = np.ascontiguousarray(m.reshape(4, rows, width).transpose(0, 2, 1))  # step within a block, block
        whole = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), rows, axis=1)
        for t in range(width):
            p = m[:, t]
            whole = np.stack([whole[0] * p[0] + whole[1] * p[2], whole[0] * p[1] + whole[1] * p[3], whole[2] * p[0] + whole[3] * p[2], whole[2] * p[1] + whole[3] * p[3]])
            whole /= whole.sum(0)
        ahead, behind = np.empty((2, rows)), np.empty((2, rows))
        x = np.array([1.0, 0.0])
        for r in range(rows):
            ahead[:, r] = x
            x = np.array([x[0] * whole[0, r] + x[1] * whole[2, r], x[0] * whole[1, r] + x[1] * whole[3, r]])
            x /= x.sum()
        x = np.array([1.0, 1.0])
        for r in range(rows - 1, -1, -1):
            behind[:, r] = x
            x = np.array([whole[0, r] * x[0] + whole[1, r] * x[1], whole[2, r] * x[0] + whole[3, r] * x[1]])
            x /= x.sum()
        alpha, beta = np.empty((2, width, rows)), np.empty((2, width, rows))
        x = ahead
        for t in range(width):
            p = m[:, t]
            x = np.stack([x[0] * p[0] + x[1] * p[2], x[0] * p[1] + x[1] * p[3]])
            x /= x.sum(0)
            alpha[:, t] = x
        x = behind
        for t in range(width - 1, -1, -1):
            beta[:, t] = x
            p = m[:, t]
            x = np.stack([p[0] * x[0] + p[1] * x[1], p[2] * x[0] + p[3] * x[1]])
            x /= x.sum(0)
        joint = alpha * beta
        flat = lambda y: y.T.reshape(-1)[:n]
        marginal = flat(joint[1] / joint.sum(0))
        if not want_pairs:
            return marginal
        al, be, mm = (np.stack([flat(z) for z in y]) for y in (alpha, beta, m))
        before = np.concatenate([[[1.0], [0.0]], al[:, :-1]], axis=1)
        pairs = np.stack([before[i] * mm[2 * i + j] * be[j] for i in (0, 1) for j in (0, 1)])
        pairs = pairs / pairs.sum(0)
        return marginal, pairs[:, ~first].sum(1)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per document: 1, log of 1 + expected toxic tokens, largest marginal, log of their share."""
        ids, lengths = self.ids(texts)
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        full = lengths > 0
        if len(ids):
            at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            first = np.zeros(len(ids), bool)
            first[at[full]] = True
            p = self.marginals(ids, first)
            total, most = np.add.reduceat(p, at[full]), np.maximum.reduceat(p, at[full])
            out[full, 1], out[full, 2] = np.log1p(total), most
            out[full, 3] = np.log1p(100 * total / lengths[full])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.layer, -30, 30)))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of the offending tokens, in characters of the lower-cased text."""
        found = list(_WORD.finditer(text.lower()))
        if not found or self.constant is not None:
            return []
        first = np.zeros(len(found), bool)
        first[0] = True
        p = self.marginals(np.asarray([self.vocabulary.get(x[0], 0) for x in found], np.int32), first)
        return [(x.start(), x.end(), float(v)) for x, v in zip(found, p, strict=True) if v >= least]


def cue_words(tokens: list[np.ndarray], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Ids of words that toxic documents hold significantly more often than clean ones."""
    counts = np.zeros((2, n_words))
    for found, y in zip(tokens, toxic, strict=True):
        counts[y, np.unique(found)] += 1
    n = np.maximum(1, np.array([(toxic == 0).sum(), (toxic == 1).sum()], float))
    (pc, pt), pool = counts / n[:, None], counts.sum(0) / n.sum()
    z = (pt - pc) / np.sqrt(pool * (1 - pool) * (1 / n).sum() + 1e-12)
    return np.flatnonzero((counts[1] >= 4) & (z > 5) & ((counts[1] + 0.5) / (n[1] + 1) > 4 * (counts[0] + 0.5) / (n[0] + 1)))


def one_of_each(tokens: list[np.ndarray], marks: np.ndarray) -> list[int]:
    """Indices of the texts with one of each group of copies, near ones included: words of copied texts are no cues."""
    seen: dict[tuple, int] = {}
    for i, found in enumerate(tokens):
        seen.setdefault(tuple(np.sort(marks[np.unique(found)])[:4].tolist()), i)
    return sorted(seen.values())


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """The chain and the logistic layer above it, from whole labelled texts."""
    if len(set(toxic.tolist())) < 2:
        return Model(constant=float(toxic.mean()) if len(toxic) else 0.0)
    known: dict[str, int] = {}
    tokens = [np.fromiter((known.setdefault(w, len(known)) for w in words(t)), np.int32) for t in texts]
    kept = one_of_each(tokens, np.fromiter((zlib.crc32(w.encode()) for w in known), np.int64, len(known)))
    texts, tokens, toxic = [texts[i] for i in kept], [tokens[i] for i in kept], toxic[kept]
    found = cue_words(tokens, toxic, len(known))
    if not len(found) or len(set(toxic.tolist())) < 2:
        return Model(constant=float(toxic.mean()))
    names = list(known)
    cues = [names[i] for i in found]
    place = np.zeros(len(known), np.int32)
    place[found] = np.arange(1, len(cues) + 1)
    model = Model({w: i + 1 for i, w in enumerate(cues)}, np.zeros(len(cues) + 1), constant=None)
    half = MAX_CHAIN_DOCS // 2
    chosen = [i for y in (0, 1) for i in np.flatnonzero(toxic == y)[:half] if len(tokens[i])]
    ids = place[np.concatenate([tokens[i] for i in chosen])]
    first = np.concatenate([np.arange(len(tokens[i])) == 0 for i in chosen])
    tag = (ids > 0) & np.concatenate([np.full(len(tokens[i]), toxic[i] == 1) for i in chosen])
    observed = np.bincount(ids, tag, minlength=len(cues) + 1)
    total = np.bincount(ids, minlength=len(cues) + 1)
    follow = np.bincount((2 * tag[:-1] + tag[1:])[~first[1:]], minlength=4).astype(float)
    begin = np.bincount(tag[first].astype(int), minlength=2).astype(float)
    model.emission = np.log((observed + 0.5) / (total - observed + 0.5))
    for _ in range(12):  # gradient steps scaled by each weight's count; the likelihood is concave
        p, pairs = model.marginals(ids, first, True)
        expected = np.bincount(ids, p, minlength=len(cues) + 1)
        model.emission += np.clip((observed - expected - 0.01 * model.emission) / (expected * (1 - expected / np.maximum(total, 1)) + 1), -1, 1)
        model.transition += np.clip((follow - pairs).reshape(2, 2) / (np.minimum(follow, pairs).reshape(2, 2) + 10), -0.5, 0.5)
        model.transition -= model.transition[0, 0]
        start = p[first]
        model.start += np.array([0, np.clip((begin[1] - start.sum()) / (start.sum() + 1), -1, 1)])
    x, w = np.concatenate([model.features(texts[k : k + 200]) for k in range(0, len(texts), 200)]), np.zeros(4)
    for _ in range(25):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4)
        w += np.linalg.solve(h, x.T @ (toxic - q) - 0.1 * w)
    model.layer = w
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    marks = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).where(~held_out())
    picked = marks.where("doc_id is not null").where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # a sample by hash
    sample = rows.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_docs).select("text", "toxic").collect()
    return train([r[0] for r in sample], np.array([r[1] for r in sample], int))


def score_column(model: Model, name: str = "text"):
    def run(parts):
        for s in parts:
            texts, out, held, size = s.fillna("").tolist(), [], [], 0
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= 2 << 20:
                    out.append(model.scores(held))
                    held, size = [], 0
            out.append(model.scores(held))
            yield pd.Series(np.concatenate(out))

    from collections.abc import Iterator

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.col(name).cast("string"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fitted(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def offending(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and the offending spans (start, end, marginal) of every row predicted toxic."""
    model = fitted(docs, labels)

    def run(parts):
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": p["score"], "spans": [[{"start": a, "end": b, "marginal": v} for a, b, v in model.spans(t)] for t in p["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).withColumn("score", score_column(model)).where(F.col("score") >= THRESHOLD)
    return rows.mapInPandas(run, "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows that are not predicted toxic."""
    model = fitted(docs, labels)
    return docs.where(score_column(model) < THRESHOLD)
