"""A quality classifier by ordinal cumulative-link regression.

Ratings are grades 0 to K-1. One weight vector over hashed text features gives each document a score s, and ordered
thresholds cut the scores into grades: P(grade <= k) = sigmoid(t_k - s). Expected grade and tail probability
P(grade >= k) follow, and a document is selected if its tail probability reaches a level.

Features are the presence of a document's distinct tokens and some shape buckets. The fit reads a bounded sample of
rated rows (`sample_rows`), stratified by nothing but a hash of the id; scoring covers every row and whole text, and
ships the weights (2^18 floats, for any input) with the scoring function.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

BITS = 18
SAMPLE_ROWS = 20_000
#: A score is the sum of a document's weights over its number of features to this power.
DAMPING = 0.2
#: Letters of a word's beginning that count as a feature of their own.
PREFIX = 4
#: Rows of average grade that every feature is taken to have besides its own.
STEADY = 5
#: The tail probability from which a document is selected.
LEVEL = 0.5
#: Distinct tokens whose features a task keeps at hand.
HELD_TOKENS = 400_000
_TRIM = b".,;:!?()[]{}\"'*#$%&|<>-_/\\"


def _bucket(name: bytes) -> int:
    return xxh32_intdigest(name) & ((1 << BITS) - 1)


def _token_features(token: bytes) -> tuple[int, ...]:
    """The bare token in lower case, its first letters, and what hangs on its end."""
    found = []
    if bare := token.strip(_TRIM).decode("utf-8", "replace").lower():
        found = [_bucket(f"w{bare}".encode()), _bucket(f"p{bare[:PREFIX]}".encode())]
    tail = token[len(token.rstrip(_TRIM)) :]
    if len(tail) > 1 or tail and tail not in b".,":
        found.append(_bucket(b"t" + tail[:4]))
    return tuple(found)


class Features:
    """Sorted feature numbers of texts; a token's features are worked out once while they are held."""

    def __init__(self):
        self.held: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        distinct = set(words)
        if len(self.held) > HELD_TOKENS:
            self.held = {}
        found = set()
        for token in distinct:
            f = self.held.get(token)
            if f is None:
                f = self.held[token] = _token_features(token)
            found.update(f)
        n = len(words)
        upper = sum(1 for w in distinct if len(w) > 1 and w.isupper())
        found.add(_bucket(b"n%d" % n.bit_length()))
        if n:
            found.add(_bucket(b"d%d" % (10 * len(distinct) // n)))
            found.add(_bucket(b"u%d" % (10 * upper // len(distinct))))
            found.add(_bucket(b"l%d" % min(20, len(text) // n)))
        return np.array(sorted(found), np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    #: K-1 rising thresholds.
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Rising thresholds from free numbers: the first one, then the logarithms of the gaps."""
    return free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]


def likelihood(scores: np.ndarray, grades: np.ndarray, weight: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log likelihood of grades, and its derivatives by the scores and by the free numbers."""
    t = np.r_[-np.inf, thresholds_of(free), np.inf]
    with np.errstate(over="ignore"):
        high, low = 1 / (1 + np.exp(scores - t[grades + 1])), 1 / (1 + np.exp(scores - t[grades]))
    p = np.maximum(high - low, 1e-9)
    dh, dl = high * (1 - high), low * (1 - low)
    dt = np.zeros(len(t))
    np.add.at(dt, grades + 1, -dh * weight / p)
    np.add.at(dt, grades, dl * weight / p)
    dt, gaps = dt[1:-1], np.exp(free[1:])
    by_free = np.r_[dt.sum(), [dt[k:].sum() * gaps[k - 1] for k in range(1, len(dt))]]
    return float(-(weight * np.log(p)).sum()), (dh - dl) * weight / p, by_free


def learn_ordinal(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 15, rate: float = 50.0, shrink: float = 1e-6, batch: int = 64, balance: float = 0.5, least_seen: int = 30, seed: int = 3) -> OrdinalModel:
    """The model of rows whose sorted features stand one after the other in `flat`, `sizes` of them each.

    Steps down the gradient of the weighted likelihood over shuffled batches, of falling size and for a fixed number of epochs: stopped
    early, so neither the likelihood's maximum nor meant to be. A row weighs the inverse of its grade's frequency to the power of `balance`. A feature's
    weight moves at the square of how far the mean grade of its rows is from the overall mean (in deviations, shrunk for
    rare ones), and not at all if it has fewer than `least_seen` rows (or a two hundredth of all, if less): features that
    tell nothing would only serve to learn rows by heart."""
    rng = np.random.default_rng(seed)
    w = np.zeros(1 << BITS)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(len(grades), 1), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.r_[start[:1], np.log(np.maximum(np.diff(start), 0.1))]  # first threshold, then logs of the gaps
    f2 = np.full(len(free), 1e-3)
    n_rows, starts = len(sizes), np.r_[0, np.cumsum(sizes)]
    row = lambda i: flat[starts[i] : starts[i + 1]]
    centred = (grades - grades.mean()) / max(grades.std(), 1e-9) if n_rows else np.empty(0)
    seen, telling = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at in range(0, n_rows, 1000):  # rows at a time: the counts' own copies stay small
        part = flat[starts[at] : starts[min(at + 1000, n_rows)]]
        seen += np.bincount(part, minlength=1 << BITS)
        telling += np.bincount(part, weights=np.repeat(centred[at : at + 1000], sizes[at : at + 1000]), minlength=1 << BITS)
    pace = (telling / (seen + STEADY)) ** 2 * (seen >= max(1, min(least_seen, n_rows // 200)))
    often = np.bincount(grades, minlength=n_grades) / max(len(grades), 1)
    weigh = (np.maximum(often, 1e-9) ** -balance)[grades]
    weigh /= weigh.mean() if len(weigh) else 1
    for epoch in range(epochs if n_rows else 0):
        step = rate / (1 + 4 * epoch / epochs)
        order = rng.permutation(n_rows)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx, n = np.concatenate([row(i) for i in some]), sizes[some]
            scale = n.astype(float) ** -DAMPING
            s = np.add.reduceat(w[idx], np.r_[0, np.cumsum(n)[:-1]]) * scale
            _, ds, df = likelihood(s, grades[some], weigh[some] / len(some), free)
            grad = np.bincount(idx, weights=np.repeat(ds * scale, n), minlength=1 << BITS)
            w -= step * pace * (grad + shrink * w)
            f2 += df**2
            free -= 0.1 * df / np.sqrt(f2)
    return OrdinalModel(w.astype(np.float32), thresholds_of(free))


def fit_ordinal(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS, **options) -> OrdinalModel:
    """The model of at most `sample_rows` ratings (id, grade), chosen by a hash of the id. Null grades or ids and
    ratings without a row are skipped; with no rating left, all weights are zero."""
    some = ratings.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_g")).where(F.col("_id").isNotNull() & F.col("_g").between(0, n_grades - 1))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_g").limit(sample_rows)
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")  # at most sample_rows

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"], "g": batch["_g"], "f": [make.of(t) for t in batch["_t"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    sample = read.mapInPandas(features, f"id {kind}, g int, f array<int>").toArrow().combine_chunks()  # at most sample_rows
    lists = sample["f"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    keys = sample.select(["id", "g"]).to_pandas().assign(size=sizes, at=np.arange(len(sizes))).sort_values(["id", "g", "size"])
    order = keys["at"].to_numpy()
    flat = lists.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)
    return learn_ordinal(flat, sizes[order], keys["g"].to_numpy(np.int64), n_grades, **options)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", tail: int | None = None, level: float = LEVEL) -> DataFrame:
    """One row per row of `docs`: the id, score, expected_grade, tail_probability (of grade `tail` or more; the top
    grade unless given) and kept (whether it reaches `level`).

    Null and empty texts have the shape features of no words and get a score like others. Repeated rows get equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    at = (len(model.thresholds) if tail is None else tail) - 1
    if not 0 <= at < len(model.thresholds):
        raise ValueError(f"grades from 1 to {len(model.thresholds)} have a tail")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features()
        for batch in batches:
            rows = [make.of(t) for t in batch["t"]]
            s = np.array([model.weights[r].sum(dtype=np.float64) / len(r) ** DAMPING for r in rows], float).reshape(-1)
            tails = model.tails(s)
            yield pd.DataFrame({"id": batch["id"], "score": s, "expected_grade": tails.sum(axis=1), "tail_probability": tails[:, at], "kept": tails[:, at] >= level})

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return read.mapInPandas(score, f"id {kind}, score double, expected_grade double, tail_probability double, kept boolean").withColumnRenamed("id", id_col)


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded ratings of the labels table: 0 of low quality, 1 toxic, 2 clean; null if a label is missing."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)
