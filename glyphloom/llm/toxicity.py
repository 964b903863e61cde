"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence scores by how far sigma(b + v), v the sum of its distinct features' weights, exceeds
sigma(b): 1 - p_s = (1 - sigma(b + v)) / (1 - sigma(b)), and 0 where v isn't positive. A document
is toxic unless all its sentences are clean and its base rate is: p = 1 - (1 - p_0) prod(1 - p_s)
(noisy-or). A sentence without evidence scores 0 and p_0 counts once a document, so that a
long text isn't toxic for its length. The document's label trains weights, b and p_0. A word's
features are hashes of the word and its prefixes, so that inflected forms of a stem share what
is learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows, bounded_part, crc_remainder, ship_package
from glyphloom.session import cut_lineage

SAMPLE_DOCS = 12_000
"""Labelled documents, about, from which the weights are learned."""
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
ROUNDS = 40
RATE = 0.7
SPARSITY = 5e-5
START_BIAS = -6.0
LEAST_TOXIC = 4
"""Toxic documents that must hold a bucket before it gets a weight."""
LEAST_EXCESS = 4.0
"""Standard deviations by which they must exceed what the bucket's frequency makes likely."""
KNOWN_WORDS = 300_000
THRESHOLD = 0.3

# What ends a sentence, and what is cut off a word's ends.
ENDS = (".", "!", "?", "…", "。")
TRIM = ".,;:!?…。\"'()[]{}<>|#*$%&«»“”‘’-_/\\"


def word_buckets(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its prefixes; none if only marks are left of it."""

    core = word.strip(TRIM).casefold()
    if not core:
        return ()
    keys = {"=" + core, *(core[:n] for n in PREFIXES if len(core) >= n)}
    return tuple(sorted({zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys}))


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of every sentence: up to a mark before white space, or a line's end."""

    text = text or ""
    import re

    start = 0
    for m in re.finditer(r"[.!?…。]+(?=\s)|\n|$", text):
        if text[start : m.end()].strip():
            yield start, m.end()
        start = m.end()


class Scorer:
    """Scores texts with learned weights; words met again come from a bounded memory."""

    def __init__(self, weights: np.ndarray, bias: float, base: float) -> None:
        self.weights, self.bias, self.base, self.known, self.told = weights, bias, base, {}, {}

    def _word(self, word: str) -> tuple[bool, bool]:
        at = [k for k in word_buckets(word) if self.weights[k]]
        if at:
            self.told[word] = at
        return (bool(at), word.endswith(ENDS) or word == "\n")  # whether a sentence ends after it

    def sentence_scores(self, text: str | None) -> np.ndarray:
        """Probability of every sentence, in order; the empty text has one empty sentence."""

        words = (text or "").replace("\n", " \n ").split(" ")
        known = self.known
        try:
            pairs = [known[w] for w in words]
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
                self.told.clear()
            for w in set(words).difference(known):
                known[w] = self._word(w)
            pairs = [known[w] for w in words]
        telling, ends = np.array(pairs, dtype=bool).T
        first = np.flatnonzero(np.append(True, ends[:-1]))
        hits = np.flatnonzero(telling)
        held: dict[int, set[int]] = {}
        for sentence, at in zip((np.searchsorted(first, hits, "right") - 1).tolist(), hits.tolist()):
            held.setdefault(sentence, set()).update(self.told[words[at]])
        v = np.zeros(len(first))
        for sentence, buckets in held.items():
            v[sentence] = self.weights[sorted(buckets)].sum()
        return -np.expm1(log_clean(v, self.bias))

    def score(self, text: str | None) -> float:
        """Noisy-or of the document's base rate and its sentences."""

        clean = 1 - noisy_or(self.sentence_scores(text))
        return float(1 - clean / (1 + np.exp(self.base)))

    def worst(self, text: str | None, least: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of sentences from ``least`` on, to show what is offending."""

        found = []
        for start, end in sentences(text):
            p = float(noisy_or(self.sentence_scores((text or "")[start:end].strip())))
            if p >= least:
                found.append((start, end, p))
        return found


def log_clean(v: np.ndarray, bias: float) -> np.ndarray:
    """log(1 - p) of sentences whose weights sum up to ``v``; 0 without evidence."""

    z = np.clip(bias + np.maximum(v, 0), -30, 30)
    return np.minimum(np.log1p(np.exp(np.clip(bias, -30, 30))) - np.log1p(np.exp(z)), 0)


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def bags(docs: DataFrame) -> DataFrame:
    """(toxic, starts, buckets) of labelled documents: sentence starts in an array of their words' buckets."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        known: dict[str, tuple[int, ...]] = {}
        for part in slices:
            out = []
            for toxic, text in part:
                starts, features, current = [0], [], set()
                for word in (text or "").replace("\n", " \n ").split(" "):
                    at = known.get(word)
                    if at is None:
                        if len(known) > KNOWN_WORDS:
                            known.clear()
                        at = known[word] = word_buckets(word)
                    current.update(at)
                    if word == "\n" or word.endswith(ENDS):
                        if current:
                            features += current
                            starts.append(len(features))
                            current = set()
                if current or len(starts) == 1:
                    features += current
                    starts.append(len(features))
                out.append((toxic, np.array(starts, np.int32).tobytes(), np.array(features, np.int32).tobytes()))
            yield out

    return arrow_rows(docs, ["toxic", "text"], "toxic int, starts binary, buckets binary", rows)


def telling_buckets(bags_table: DataFrame, n: int, n_toxic: int) -> np.ndarray:
    """Buckets that toxic documents hold far more often than chance has it; at most ``BUCKETS`` numbers."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        held = np.zeros((2, BUCKETS), np.int32)
        for part in slices:
            for toxic, buckets in part:
                held[toxic, np.unique(np.frombuffer(buckets, np.int32))] += 1
        for low in range(0, BUCKETS, 1 << 14):
            block = held[:, low : low + (1 << 14)]
            yield [(low + int(k), int(block[0, k]), int(block[1, k])) for k in np.flatnonzero(block[1])]

    counts = arrow_rows(bags_table, ["toxic", "buckets"], "bucket int, clean int, toxic int", rows)
    total = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    expected = (F.col("clean") + F.col("toxic")) * (n_toxic / n)
    telling = total.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") - expected >= LEAST_EXCESS * F.sqrt(expected)))
    return np.array([r["bucket"] for r in telling.select("bucket").toLocalIterator()], np.int64)


def train(bags_table: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """Weights, the sentences' bias and the documents' from full-batch gradients summed per partition, AdaGrad steps on the driver.

    A round is one Spark job; a partition sends back one number per telling bucket, whatever
    the number of documents.
    """

    counts = {r["toxic"]: r["count"] for r in bags_table.groupBy("toxic").count().collect()}
    n, weights = sum(counts.values()), np.zeros(BUCKETS)
    if len(counts) < 2:
        return weights, START_BIAS, -START_BIAS if counts.get(1) else START_BIAS
    telling = telling_buckets(bags_table, n, counts[1])
    narrow = cut_lineage(_narrowed(bags_table, telling))
    w, bias, base = np.ones(len(telling)), START_BIAS, START_BIAS
    squares = np.full(len(telling) + 2, 1e-8)
    for _ in range(rounds):
        gradient = _gradient(narrow, w, bias, base) / n
        gradient[:-2] += SPARSITY * np.sign(w)
        squares += gradient**2
        step = RATE * gradient / np.sqrt(squares)
        w, bias, base = w - step[:-2], bias - float(step[-2]), base - float(step[-1])
    weights[telling] = w
    return weights, bias, base


def _narrowed(bags_table: DataFrame, telling: np.ndarray) -> DataFrame:
    """(toxic, sizes, places): per sentence the number of its telling buckets, and their places in ``telling``."""

    place = np.full(BUCKETS, -1, np.int32)
    place[telling] = np.arange(len(telling), dtype=np.int32)

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            out = []
            for toxic, starts, buckets in part:
                at = place[np.frombuffer(buckets, np.int32)]
                begins = np.frombuffer(starts, np.int32)
                total = np.append(0, np.cumsum(at >= 0))
                out.append((toxic, np.diff(total[begins]).astype(np.int32).tobytes(), at[at >= 0].tobytes()))
            yield out

    return arrow_rows(bags_table, ["toxic", "starts", "buckets"], "toxic int, sizes binary, places binary", rows)


def _gradient(narrow: DataFrame, w: np.ndarray, bias: float, base: float) -> np.ndarray:
    """Sums over documents: a number per weight, then one for ``bias`` and one for ``base``."""

    def sigma(z: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        total = np.zeros(len(w) + 2)
        for part in slices:
            toxic = np.array([r[0] for r in part])
            sizes = [np.frombuffer(r[1], np.int32) for r in part]
            places = np.concatenate([np.frombuffer(r[2], np.int32) for r in part])
            doc = np.repeat(np.arange(len(part)), [len(x) for x in sizes])
            flat = np.concatenate(sizes)
            sentence = np.repeat(np.arange(len(flat)), flat)
            v = np.bincount(sentence, w[places], len(flat))
            clean = np.exp(np.bincount(doc, log_clean(v, bias), len(part))) * (1 - sigma(base))
            # d loss / d log(clean), negated: 1 in a clean document, -clean / (1 - clean) in a toxic one.
            g = np.where(toxic == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            d = np.where(v > 0, g[doc] * sigma(bias + v), 0.0)
            total[:-2] += np.bincount(places, d[sentence], len(w))
            total[-2] += np.where(v > 0, d - g[doc] * sigma(bias), 0.0).sum()
            total[-1] += (g * sigma(base)).sum()
        yield [(total.tobytes(),)]

    sums = arrow_rows(narrow, ["toxic", "sizes", "places"], "total binary", rows).toLocalIterator()
    return sum((np.frombuffer(r["total"]) for r in sums), np.zeros(len(w) + 2))


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float, float]:
    """Train on labelled rows of ``docs`` whose crc32 remainder of 4 isn't ``held_out``; rows without a label don't count."""

    known = labels.filter("toxic in (0, 1)").select(F.col(key).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        known = known.filter(crc_remainder(F.col("doc_id"), 4) != held_out)
    known = bounded_part(known, SAMPLE_DOCS, F.col("doc_id"))
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id")
    return train(cut_lineage(bags(chosen).repartition(4)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row from its whole text; null scores as the empty text. Nothing is shuffled."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        scorer = Scorer(*model)
        for part in slices:
            yield [(doc_id, scorer.score(value)) for doc_id, value in part]

    return arrow_rows(docs, [key, text], f"`{key}` {dict(docs.dtypes)[key]}, score double", rows)


def score_column(spark: SparkSession, model: tuple[np.ndarray, float, float]) -> Callable[[Column], Column]:
    """A function from a text column to its score, for filters that keep all columns."""

    ship_package(spark)
    scorer = Scorer(*model)
    return F.udf(lambda value: scorer.score(value), "double", useArrow=True)


def offending(docs: DataFrame, model: tuple[np.ndarray, float, float], least: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, score, sentence): every sentence that scores ``least`` or more."""

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        scorer = Scorer(*model)
        for part in slices:
            yield [(doc_id, a, b, p, value[a:b].strip()) for doc_id, value in part if value for a, b, p in scorer.worst(value, least)]

    return arrow_rows(docs, [key, text], f"`{key}` {dict(docs.dtypes)[key]}, start int, `end` int, score double, sentence string", rows)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``docs``.

    A null key is held out of training and marked so. Without labels of both kinds all rows
    get one score.
    """

    found = scored(docs, learn(docs, labels, key=key, text=text), key, text)
    return found.select(
        key, F.coalesce(crc_remainder(F.col(key), 4) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
