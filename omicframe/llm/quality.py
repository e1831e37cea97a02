"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitting sample: rows nearest to 0 by a hash of their id.
POSITIVES, UNLABELLED = 4000, 8000


def _classes() -> np.ndarray:
    """Byte -> one of 16 character classes."""
    c = np.full(256, 15, np.uint8)  # bytes of letters beyond ASCII
    c[:32], c[10], c[13] = 14, 0, 0
    c[ord(" ")], c[9] = 1, 1
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 2, 3, 4
    for k, group in enumerate((".", ",", "!", "?", ":;", "'\"", "()[]{}<>", "-_/\\|", "#$%&*+=@^~`")):
        for ch in group:
            c[ord(ch)] = 5 + k
    return c


CLASSES = _classes()
N_FEATURES = 16 + 256 + 9


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and of pairs of them, and the repetitiveness and size of words and lines. A null or
    empty text has zeros, but for the size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    if raw:
        k = CLASSES[np.frombuffer(raw, np.uint8)]
        out[:16] = np.bincount(k, minlength=16) / len(k)
        if len(k) > 1:
            out[16:272] = np.bincount((k[:-1] << 4) | k[1:], minlength=256) / (len(k) - 1)
        words, lines = raw.split(), raw.split(b"\n")
        n = max(1, len(words))
        again = sum(map(bytes.__eq__, words[1:], words[:-1]))
        out[272:] = (
            len(set(words)) / n,
            again / n,
            len(set(lines)) / len(lines),
            min(1.0, len(raw) / n / 20),
            min(1.0, len(lines) / n),
            np.log1p(n) / 10,
            sum(w[-1:] in b".,!?" for w in words) / n,
            sum(map(bytes.isupper, words)) / n,
            min(1.0, max(map(len, words), default=0) / 100),
        )
    return np.sqrt(out)


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.04, decay: float = 1e-4) -> dict:
    """A linear score that minimises the non-negative unbiased risk
    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]) with the logistic loss; where the second part
    is negative its gradient is turned round. Adam on the whole sample; the same sample gives the same weights."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=float) + unlabelled.sum(0, dtype=float)) / n
    spread = np.sqrt((((positive - mean) ** 2).sum(0) + ((unlabelled - mean) ** 2).sum(0)) / n) + 1e-3
    p, u = (np.hstack([(x - mean) / spread, np.ones((len(x), 1))]).clip(-8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-z.clip(-30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        kept = prior * p.T @ (-sigmoid(-gp)) / len(p)
        rest = u.T @ sigmoid(gu) / len(u) - prior * p.T @ sigmoid(gp) / len(p)
        negative = softplus(gu).mean() - prior * softplus(gp).mean() < 0
        grad = (-rest if negative else kept + rest) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "spread": spread, "w": w}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.hstack([(x - model["mean"]) / model["spread"], np.ones((len(x), 1))]).clip(-8, 8) @ model["w"]
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def _featured(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).astype("<f4").tobytes() for t in texts])


def _nearest(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(F.abs(F.xxhash64("id")), "id").limit(n)


def class_prior(known: DataFrame) -> float:
    """Share of positives among the labelled fitting rows, smoothed towards one half."""
    n, s = known.agg(F.count("good"), F.sum("good")).first()
    return ((s or 0) + 1) / (n + 2)


def train(docs: DataFrame, labels: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """Fit on rows of ``labels`` (doc_id, quality) for which the column function ``fold`` of the id holds, and on
    unlabelled rows of ``docs``.

    Trusted positives: at most ``positives`` documents labelled 1. Unlabelled web text: at most ``unlabelled``
    documents of any kind (their labels are not looked at). Both samples are those nearest to 0 by a hash of the id, so
    they do not depend on the order of rows. The class prior is estimated from all labelled fitting rows. Without a
    positive there is nothing to fit: None. The bounds concern the fit alone; scores cover every row.
    """
    known = labels.where(fold(F.col(id_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("good"))
    prior = class_prior(known)
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    chosen = ids.join(known.where("good = 1"), "id", "left_semi").distinct()
    p = _nearest(chosen, positives).withColumn("positive", F.lit(True))
    u = _nearest(ids.where(fold(F.col("id"))).distinct(), unlabelled).withColumn("positive", F.lit(False))
    wanted = p.union(u)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sample = texts.join(F.broadcast(wanted), "id").select("positive", "id", F.pandas_udf(_featured, "binary")("text").alias("x"))
    rows: dict[tuple[bool, int], bytes] = {}
    for r in sample.collect():  # at most positives + unlabelled ids, about 1 KB each
        rows[r.positive, r.id] = min(r.x, rows.get((r.positive, r.id), r.x))
    pos, unl = (np.frombuffer(b"".join(rows[k] for k in sorted(rows) if k[0] == want), "<f4").reshape(-1, N_FEATURES) for want in (True, False))
    del rows
    return fitted(pos, unl, prior) if len(pos) and len(unl) else None


def scored(docs: DataFrame, model: dict | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text; only the text counts. Null and empty texts get a score
    like any other; without a model every score is 0.5."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    @F.pandas_udf("double")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.withColumn(out, mark(F.col(text_col)))


def held_out(doc_id):
    """The rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
