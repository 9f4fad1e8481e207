"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w . x) with one weight vector w for all ordered thresholds. x marks which features of
a selected vocabulary a text has: words, and beginnings of longer words, which inflected forms share; some speak for toxic
texts, some against. Labelled toxic texts are graded 1 to 3 by the share of words that are typical of toxic texts, others 0. The
output is the expected severity, the sum of P(grade > k).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import arrow_map, attach, column, cut, keyed, public_id, record_batch, texts

GRADES = 4
#: Most labelled rows that the fit reads, and most features of the vocabulary.
SAMPLE_ROWS, VOCABULARY = 4_000, 512
#: A feature is a candidate if so many labelled texts have it and its log-odds are this many deviations from zero.
MIN_TEXTS, MIN_Z = 3, 3.0
#: Bytes of the beginning of a longer word.
STEM = 8
#: A text counts as toxic if its expected severity is so far above that of a text without known words.
TOXIC = 0.1
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def features_of(words: list[bytes]) -> set[bytes]:
    """Words, and the beginnings of longer ones with a mark before them."""
    own = set(words)
    return own | {b"^" + w[:STEM] for w in own if len(w) > STEM}


@dataclass
class Model:
    words: dict[bytes, float]
    thresholds: list[float]

    def severity(self, text: bytes) -> float:
        x = sum(map(self.words.__getitem__, sorted(self.words.keys() & features_of(words_of(text)))))
        return float(sum(1 / (1 + np.exp(np.clip(t - x, -50, 50))) for t in self.thresholds))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES, rounds: int = 400, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest penalised likelihood, by Adam on full batches."""
    p = np.zeros(x.shape[1] + grades - 1)
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    p[x.shape[1]] = start[0]
    p[x.shape[1] + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = x.shape[1]
    for step in range(1, rounds + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        t = np.concatenate(([-np.inf], p[d] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        z = x @ w
        upper, lower = (1 / (1 + np.exp(-np.clip(t[y + k] - z, -40, 40))) for k in (1, 0))
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gz = (du - dl) / len(y)
        gt = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(y) for k in range(grades - 1)])
        gp = np.concatenate((x.T @ gz + ridge * w / 10, [gt.sum()], [gt[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]))
        m, v = 0.9 * m + 0.1 * gp, 0.999 * v + 0.001 * gp * gp
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:d], p[d] + np.concatenate(([0], np.cumsum(np.exp(p[d + 1 :]))))


_SCORE = pa.schema([("_id", pa.int64()), ("severity", pa.float64())])
_BAG = pa.schema([("toxic", pa.int32()), ("m0", pa.int64()), ("m1", pa.int64()), ("_text", pa.string())])
_WORDS = pa.schema([("toxic", pa.int32()), ("word", pa.binary())])
_ROW = pa.schema([("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("share", pa.float64())])


def _prints(batches):
    """Two min-hashes of the word triples of labelled texts, which near copies share."""
    for batch in batches:
        words = [words_of(t) for t in texts(batch)]
        triples = [{b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for w in words]
        least = [[min(xxhash.xxh3_64_intdigest(t, seed=s) for t in x) >> 1 for x in triples] for s in (0, 1)]
        yield record_batch(_BAG, column(batch, "toxic"), *least, column(batch, "_text"))


def _words(batches):
    for batch in batches:
        found = [(y, w) for y, t in zip(column(batch, "toxic"), texts(batch), strict=True) for w in features_of(words_of(t))]
        yield record_batch(_WORDS, *zip(*found, strict=True)) if found else record_batch(_WORDS, [], [])


def _features(words: list[bytes], positive: set[bytes]):
    """Which of the features a text has, and the share of its words that are typical of toxic texts."""
    at = {w: k for k, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            bags = [words_of(t) for t in texts(batch)]
            typical = [sum(w in positive or b"^" + w[:STEM] in positive for w in b) / max(1, len(b)) for b in bags]
            yield record_batch(_ROW, column(batch, "toxic"), [sorted(at[f] for f in features_of(b) if f in at) for b in bags], typical)

    return run


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled texts, one of near copies; without toxic or other texts nothing is toxic.

    Features are counted and chosen by Spark; the driver gets at most VOCABULARY of them, and of each text only which it
    has. Null labels, ids and texts are left out; of several labels of an id the largest holds. Empty tables give a
    model without words. Other columns are ignored.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id is not null and toxic is not null")
    marks = cut(marks.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    some = attach(keyed(df, id_col, text_col), marks, "_id", "inner").where("_text is not null").groupBy("_text").agg(F.max("toxic").alias("toxic"))
    some = arrow_map(some, _prints, "toxic int, m0 long, m1 long, _text string")
    for m in ("m0", "m1"):  # one text of a family of near copies
        some = some.groupBy(m).agg(F.min_by(F.struct(*some.columns), F.struct("toxic", "m0", "m1", "_text")).alias("x")).select("x.*")
    some = cut(some.select("toxic", "_text"))
    n, bad = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return Model({}, [50.0] * (GRADES - 1))
    have = arrow_map(some, _words, "toxic int, word binary").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(f"a + b >= {MIN_TEXTS}")
    odds = F.expr(f"ln((a + 0.5) / ({bad} - a + 0.5)) - ln((b + 0.5) / ({n - bad} - b + 0.5))")
    z = odds / F.expr(f"sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / ({bad} - a + 0.5) + 1 / ({n - bad} - b + 0.5))")
    chosen = have.withColumn("z", F.round(z, 9)).where(f"abs(z) >= {MIN_Z}").orderBy(F.desc(F.abs("z")), "word").limit(VOCABULARY).collect()
    words, positive = [bytes(r["word"]) for r in chosen], {bytes(r["word"]) for r in chosen if r["z"] > 0}
    if not positive:
        return Model({}, [50.0] * (GRADES - 1))
    rows = sorted((r["toxic"], r["share"], r["found"]) for r in arrow_map(some, _features(words, positive), "toxic int, found array<int>, share double").collect())
    toxic, share = np.array([r[0] for r in rows], bool), np.array([r[1] for r in rows])
    cuts = np.quantile(share[toxic & (share > 0)], (1 / 3, 2 / 3)) if (toxic & (share > 0)).any() else (0.0, 0.0)
    grade = np.where(toxic, 1 + (share > cuts[0]).astype(int) + (share > cuts[1]), 0)
    x = np.zeros((len(rows), len(words)))
    for k, r in enumerate(rows):
        x[k, r[2]] = 1
    w, thresholds = fit_ordinal(x, grade)
    return Model(dict(zip(words, w.tolist(), strict=True)), thresholds.tolist())


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            yield record_batch(_SCORE, column(batch, "_id"), [round(model.severity(t), 6) for t in texts(batch)])

    return run


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, severity (expected grade, 0 to 3), toxic (severity clearly above that of no known
    word).

    A null or empty text has no feature and gets the least severity of a text without known words. Whole texts are read;
    repeated rows give equal rows; null ids stay. Other columns are ignored.
    """
    done = arrow_map(keyed(df, id_col, text_col), _scores(model), "_id long, severity double")
    return done.select(public_id().alias(id_col), "severity", (F.col("severity") >= model.severity(b"") + TOXIC).alias("toxic"))
