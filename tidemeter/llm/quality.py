"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the shapes of its words (letter case, digits, marks, repetition) and its short words, hashed to a
fixed number of buckets. Shares of terms, weighted by rarity, are projected to the leading directions of a bounded
sample of labelled texts. The sample's vectors and labels are broadcast; every document is compared with all of them
by exact cosines in blocks, and its nearest ones vote with their similarity.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = 1024
#: Buckets of their own: words that repeat the one before, words that stood earlier in the text.
REPEAT, AGAIN = TERMS, TERMS + 1
WIDTH = TERMS + 2


def shape(word: str) -> str:
    """Runs of letters by case, digits and marks: ``Hello,`` gives ``Aa,``; runs of one kind count once, long words twice."""
    out, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out[:12]) + (str(min(len(word) // 5, 4)))


class TermCounter:
    """Term shares of texts; terms of the words met lately are remembered."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def term(self, word: str) -> int:
        bare = word.lower().strip(".,")
        key = shape(word) if len(bare) > 3 or not bare.isalpha() else "=" + bare
        return zlib.crc32(key.encode("utf-8", "surrogatepass")) % TERMS

    def shares(self, text: str | None) -> np.ndarray:
        """Square roots of the terms' shares; zero for a text without words."""
        words = (text or "").split()
        out = np.zeros(WIDTH)
        if not words:
            return out
        known = self.known
        distinct = set(words)
        if len(known) > self.most:
            known.clear()
        for word in distinct.difference(known):
            known[word] = self.term(word)
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=TERMS)
        out[:TERMS] = counts
        out[REPEAT] = sum(map(eq, words, words[1:]))
        out[AGAIN] = len(words) - len(distinct)
        return np.sqrt(out / len(words))


class Model:
    """Projection, labelled vectors and vote weights."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, prior: float, rank: int, neighbours: int):
        self.prior, self.neighbours, self.labels = prior, neighbours, labels.astype(np.float64)
        present = (shares > 0).sum(0)
        self.rarity = np.log((1 + len(shares)) / (1 + present)) + 1
        _, vectors = np.linalg.eigh((shares * self.rarity).T @ (shares * self.rarity))
        self.axes = vectors[:, ::-1][:, : min(rank, len(shares))] * self.rarity[:, None]
        self.vectors = self._unit(shares @ self.axes)
        # The sample holds both labels alike; votes are weighed back to their shares among all labelled rows.
        own = max(float(self.labels.mean()), 1e-9), max(1 - float(self.labels.mean()), 1e-9)
        self.weights = np.where(self.labels > 0, prior / own[0], (1 - prior) / own[1])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum(1))
        return x / np.where(norm > 0, norm, 1)[:, None]

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors; the prior where a text has no terms."""
        near = self._unit(shares @ self.axes) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 8 * self.weights[top]
        total = weight.sum(1)
        vote = (weight * self.labels[top]).sum(1)
        # One vote's worth of the prior keeps texts like no labelled one near the prior.
        return np.clip(np.where(shares.any(1), (vote + 0.01 * self.prior) / (total + 0.01), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_label: int = 2048, rank: int = 64, neighbours: int = 15) -> Model | None:
    """A model from at most ``per_label`` labelled rows of each label, those with the smallest hashes of their id.

    ``learn`` is a condition on ``doc_id``. Rows of ``labels`` with a null id or label are left out; of several rows with one
    id the largest label counts. None if no labelled row has a document.
    """
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    totals = dict(marked.groupBy("label").count().collect())
    if not totals:
        return None
    prior = totals.get(1, 0) / sum(totals.values())
    hashed = F.xxhash64("doc_id")
    parts = [marked.where(F.col("label") == v).orderBy(hashed, "doc_id").limit(per_label) for v in sorted(totals)]
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # At most two times per_label ids: small enough to send to all tasks.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    texts = rows.join(F.broadcast(chosen), "doc_id")

    def count(batches):
        import pyarrow as pa

        terms = TermCounter()
        for batch in batches:
            shares = [terms.shares(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.binary()), batch.column(2)], ["doc_id", "shares", "label"])

    found = texts.select("doc_id", "text", "label").mapInArrow(count, "doc_id long, shares binary, label int")
    found = found.groupBy("doc_id").agg(F.max("shares").alias("shares"), F.max("label").alias("label")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    shares = np.stack([np.frombuffer(s.as_buffer(), np.float32) for s in found.column("shares")]).astype(np.float64)
    return Model(shares, found.column("label").to_numpy(), prior, rank, neighbours)


def score_quality(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """``row`` (all columns of ``docs``), ``score`` and ``predicted`` (1 if the score is ``least`` or more) of every row.

    The score is a function of the text alone. Texts that are null, empty or without words get the share of label 1 among
    labelled rows; without a model every score is 0.5. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def score(texts):
        import pandas as pd

        terms, own = TermCounter(), shared.value
        for series in texts:
            out = []
            values = series.tolist()
            for start in range(0, len(values), 256):
                part = values[start : start + 256]
                out.append(np.full(len(part), 0.5) if own is None else own.score(np.stack([terms.shares(t) for t in part])))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = whole.withColumn("score", pandas_udf(score, "double")(F.col("row.text")))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
