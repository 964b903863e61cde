"""Quality scores: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes some twenty statistics. cos(w.x + b) with Gaussian w approximates a Gaussian
kernel over the standardised statistics; ridge weights solve normal equations that every
partition sums on its own. A held-back fold of the training rows calibrates scores by
pooling adjacent violators over score bins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows, bounded_part, crc_remainder
from glyphloom.session import cut_lineage

SAMPLE_DOCS = 20_000
"""Labelled documents, about, that are fitted on."""
FEATURES = 256
GAMMA = 0.05
RIDGE = 1e-2
BINS = 1_000
CALIBRATION_FOLD = 5
"""Every so many-th training row calibrates and isn't fitted on."""
SEED = 7

# Classes of ASCII bytes that statistics count.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".!?", b",;:", b"\n", b"\"'()[]{}", b"/\\_=+~^@")
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS_OF[list(_chars)] = _k
N_STATS = len(CLASSES) + 10


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for an empty one."""

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    n, size = len(words), len(raw)
    shares = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)] / size
    distinct = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    return [
        *np.sqrt(shares).tolist(), float(np.log1p(n)), (size - n + 1) / n, float(np.log1p(max(map(len, distinct)))), len(distinct) / n,
        max(distinct.values()) / n, pairs / max(n - 1, 1), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        len(zlib.compress(raw[:], 1)) / size, sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    """Standardisation, projection, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return _fourier((stats - self.mean) / self.scale, self.directions, self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated scores; a slight slope inside pooled blocks keeps the order of raw scores."""

        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.cos(x @ directions + phases) * np.sqrt(2 / len(phases))
    return np.hstack([z, np.clip(x, -5, 5), np.ones((len(x), 1))])


def _measured(docs: DataFrame, extra: list[str], fields: str) -> DataFrame:
    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            yield [(*r[:-1], statistics(r[-1])) for r in part]

    return arrow_rows(docs, [*extra, "text"], f"{fields}, stats array<double>", rows)


def fit(measured: DataFrame, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE) -> Model:
    """A model from (id, label, stats). The driver gets sums whose size doesn't depend on the rows."""

    calibrate = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CALIBRATION_FOLD)) == 0
    first = measured.select(*(F.col("stats")[k].alias(f"s{k}") for k in range(N_STATS))).agg(
        *(F.avg(f"s{k}") for k in range(N_STATS)), *(F.stddev_pop(f"s{k}") for k in range(N_STATS))
    ).first()
    filled = np.array([v or 0.0 for v in first])
    mean, scale = filled[:N_STATS], np.maximum(filled[N_STATS:], 1e-3)
    random = np.random.default_rng(SEED)
    directions = random.normal(size=(N_STATS, features)) * np.sqrt(2 * gamma)
    phases = random.uniform(0, 2 * np.pi, features)
    wide = features + N_STATS + 1

    def sums(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        total = np.zeros((wide + 1, wide))
        for part in slices:
            labels, stats = (np.array(c, float) for c in zip(*part))
            z = _fourier((stats - mean) / scale, directions, phases)
            total[:-1] += z.T @ z
            total[-1] += labels @ z
        yield [(k, row.tobytes()) for k, row in enumerate(total)]

    def added(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        total: dict[int, np.ndarray] = {}
        for part in slices:
            for k, row in part:
                total[k] = total.get(k, 0) + np.frombuffer(row)
        yield [(k, row.tobytes()) for k, row in total.items()]

    partial = arrow_rows(measured.filter(~calibrate), ["label", "stats"], "k int, line binary", sums)
    total = np.zeros((wide + 1, wide))
    for r in arrow_rows(partial.repartition(4, "k"), ["k", "line"], "k int, line binary", added).toLocalIterator():
        total[r["k"]] += np.frombuffer(r["line"])
    weights = np.linalg.solve(total[:-1] + ridge * np.eye(wide), total[-1])
    plain = Model(mean, scale, directions, phases, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            labels, stats = (np.array(c, float) for c in zip(*part))
            yield list(zip(np.clip(np.round(plain.raw(stats) * BINS / 2 + BINS / 4), 0, BINS).astype(int).tolist(), labels.tolist()))

    bins = arrow_rows(measured.filter(calibrate), ["label", "stats"], "bin int, label double", binned).groupBy("bin").agg(F.count("*"), F.sum("label"))
    rows = sorted(tuple(r) for r in bins.collect())  # BINS + 1 rows at most
    if not rows:
        return plain
    blocks: list[list[float]] = []
    for at, n, positive in rows:
        blocks.append([n * (at - BINS / 4) * 2 / BINS, n, positive])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots, levels = np.array([[s / n, p / n] for s, n, p in blocks]).T
    return Model(mean, scale, directions, phases, weights, knots, levels)


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, key: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on labelled rows whose crc32 remainder of 3 isn't ``held_out``; None without any."""

    known = labels.filter("quality in (0, 1)").select(F.col(key).alias("id"), F.col("quality").cast("double").alias("label"))
    if held_out is not None:
        known = known.filter(crc_remainder(F.col("id"), 3) != held_out)
    known = bounded_part(known, SAMPLE_DOCS, F.col("id"))
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(known, "id")
    measured = cut_lineage(_measured(chosen, ["id", "label"], "id bigint, label double"))
    return None if measured.isEmpty() else fit(measured)


def scored(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row from its whole text; null is the empty text. Without a model the score is 0.5."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            if model is None:
                yield [(doc_id, 0.5) for doc_id, _ in part]
            elif part:
                scores = model.calibrated(model.raw(np.array([statistics(value) for _, value in part])))
                yield [(r[0], s) for r, s in zip(part, scores.tolist())]

    return arrow_rows(docs, [key, text], f"`{key}` {dict(docs.dtypes)[key]}, score double", rows)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``; a null key counts as held out."""

    found = scored(docs, learn(docs, labels, key=key, text=text), key, text)
    return found.select(
        key, F.coalesce(crc_remainder(F.col(key), 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
