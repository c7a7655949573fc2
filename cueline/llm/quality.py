"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document: good, poor, or no vote.
The counts of all vote patterns over the whole table are sufficient statistics
for a model with one accuracy table per labeller, which expectation maximisation
fits without any labels; it gives each pattern a posterior probability of good.
Those posteriors are the targets of a linear scorer over hashed runs of byte
classes and repetition shares, trained on a sample of at most ``2 * SAMPLE_ROWS``
documents. The scorer then rates every document on its whole text, and documents
below ``THRESHOLD`` are rejected.

The number of patterns is bounded by the labellers (``3 ** 11``), so the driver
sees neither documents nor anything that grows with them, but the sample.

Defined results: null and empty texts have no features and are kept with a
score of 1 (nothing speaks against them). Null and repeated ``doc_id`` values are
rows like any other. An empty table gives no rows. Extra columns are ignored by
``rate`` and kept by ``reject_poor``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.tables import read
from cueline.llm.words import Words, mix, shingles_of, slices, text_bytes, words_of

GOOD, POOR, NONE = 1, 0, 2
#: Expected documents of the training sample.
SAMPLE_ROWS = 4_000
THRESHOLD = 0.5
#: Prior share of good texts that a labeller calls poor, and the prior's weight.
FALSE_ALARMS, PRIOR_WEIGHT = 0.002, 0.2
#: Hashed features, and bytes of a run.
WIDTH, RUN = 2_048, 5
#: Runs that say nothing, added to every text: short texts give little evidence.
SMOOTHING = 64
#: Features that are scaled at a time.
_COLUMNS = 64

#: Classes of bytes: lower letters, capitals, digits, blanks, line ends, marks of sentences, "!", symbols, other letters.
_LOWER, _CAPITAL, _DIGIT, _BLANK, _LINE, _MARK, _SHOUT, _SYMBOL, _OTHER = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _CAPITAL, _DIGIT, _OTHER
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[ord("!")] = _BLANK, _LINE, _SHOUT
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _MARK

#: Labellers: a figure of the text, the bound from which it is poor, the bound below which it is good, and
#: the words that a text needs for a vote.
LABELLERS = (
    ("symbols", 0.02, 0.005, 1),
    ("symbol_words", 0.20, 0.05, 5),
    ("symbol_ends", 0.15, 0.05, 5),
    ("capitals", 0.40, 0.15, 5),
    ("shouts", 0.50, 0.10, 5),
    ("bare_marks", 0.15, 0.05, 5),
    ("repeats", 0.20, 0.05, 10),
    ("same_runs", 0.45, 0.15, 20),
    ("same_words", 0.80, 0.60, 50),
    ("word_length", 8.5, 7.5, 20),
    ("no_sentences", 0.995, 0.98, 30),
)


class Shares(NamedTuple):
    """Figures of each text of a slice; ``table`` has one column per labeller."""

    table: np.ndarray
    n_words: np.ndarray


def _distinct(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n_rows)


def shares(words: Words, row_bytes: np.ndarray) -> Shares:
    """The labellers' figures for the rows of ``words``; ``row_bytes`` are their offsets in the data."""
    n, size = len(row_bytes) - 1, np.diff(row_bytes)
    classes = np.bincount(np.repeat(np.arange(n) * 9, size) + _CLASS[words.data], minlength=9 * n).reshape(n, 9)
    n_words, rows = np.diff(words.offsets), words.rows()
    per_word = np.maximum(n_words, 1)
    same = np.zeros(len(rows), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    runs, run_offsets = shingles_of(words)
    n_runs = np.diff(run_offsets)
    letters = np.concatenate([[0], np.cumsum((_CLASS[words.data] <= _DIGIT) | (_CLASS[words.data] == _OTHER))])
    bare = letters[words.ends] == letters[words.starts]
    symbols = np.concatenate([[0], np.cumsum(_CLASS[words.data] == _SYMBOL)])
    ends = np.isin(words.data[words.ends - 1], np.frombuffer(b".!?", np.uint8))
    letter_total = np.maximum(classes[:, [_LOWER, _CAPITAL]].sum(axis=1), 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows[flags], minlength=n) / per_word

    table = np.column_stack([
        classes[:, _SYMBOL] / np.maximum(size, 1),
        share(symbols[words.ends] > symbols[words.starts]),
        share(_CLASS[words.data[words.ends - 1]] == _SYMBOL),
        classes[:, _CAPITAL] / letter_total,
        classes[:, _SHOUT] / per_word,
        share(bare),
        share(same),
        1 - _distinct(np.repeat(np.arange(n), n_runs), runs, n) / np.maximum(n_runs, 1),
        1 - _distinct(rows, words.hashes, n) / per_word,
        (size - classes[:, _BLANK] - classes[:, _LINE]) / per_word,
        1 - share(ends),
    ])
    return Shares(table, n_words)


def votes(found: Shares) -> np.ndarray:
    """One row per text, one column per labeller."""
    poor_from, good_below, least = (np.array([labeller[k] for labeller in LABELLERS]) for k in (1, 2, 3))
    cast = np.where(found.table >= poor_from, POOR, np.where(found.table < good_below, GOOD, NONE))
    return np.where(found.n_words[:, None] >= least, cast, NONE)


def _names(cast: np.ndarray) -> list[str]:
    return ["".join(map(str, row)) for row in cast.tolist()]


class LabelModel(NamedTuple):
    """Prior of good, and ``accuracy[labeller, true label, vote]``; to give no vote says nothing."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        logs = np.concatenate([np.log(self.accuracy), np.zeros((*self.accuracy.shape[:2], 1))], axis=2)
        each = logs[np.arange(cast.shape[1])[None, :], :, cast].sum(axis=1)  # (rows, 2)
        odds = each[:, GOOD] - each[:, POOR] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit_labels(cast: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts.

    It starts from "poor where any labeller says so", the side on which heuristics
    seldom err, and stops when the posteriors stand still. That labellers seldom
    call good texts poor is also the prior of their tables, with a weight of
    ``PRIOR_WEIGHT`` of the documents; without it, kinds of poor text that few
    labellers see would count as their errors.
    """
    prior_votes = np.array([FALSE_ALARMS, 1 - FALSE_ALARMS]) * PRIOR_WEIGHT * counts.sum()
    poor = (cast == POOR).any(axis=1)
    good = np.where(poor, 0.1, 0.95)
    model = LabelModel(0.5, np.full((cast.shape[1], 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.stack([[[(w * (cast[:, j] == v)).sum() for v in (POOR, GOOD)] for w in weight] for j in range(cast.shape[1])]) + 1.0
        table[:, GOOD] += prior_votes
        accuracy = table / table.sum(axis=2, keepdims=True)
        prior = float((weight[GOOD].sum() + 1) / (counts.sum() + 2))
        model = LabelModel(prior, accuracy)
        before, good = good, model.posterior(cast)
        if np.abs(good - before).max() < 1e-6:
            break
    return model


def hashed(words: Words, row_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed feature of every run of byte classes, and the rows' offsets."""
    codes = _CLASS[words.data].astype(np.uint64)
    total = np.zeros(max(len(codes) - RUN + 1, 0), np.uint64)
    for i in range(RUN):
        total = total * np.uint64(9) + codes[i : i + len(total)]
    features = (mix(total) & np.uint64(WIDTH - 1)).astype(np.int64)
    # Runs that reach into the next text are left out.
    last = np.repeat(row_bytes[1:] - RUN, np.diff(row_bytes))[: len(total)]
    inside = np.arange(len(total)) <= last
    return features[inside], np.concatenate([[0], np.cumsum(np.maximum(np.diff(row_bytes) - RUN + 1, 0))])


class Scorer(NamedTuple):
    """Logistic regression over hashed frequencies and the labellers' shares."""

    bias: float
    hashed: np.ndarray
    shares: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of good for each text of a slice."""
        words, row_bytes = _parsed(column)
        features, offsets = hashed(words, row_bytes)
        sums = np.concatenate([[0.0], np.cumsum(self.hashed[features])])
        n = np.diff(offsets)
        figures = shares(words, row_bytes)
        logit = self.bias + (sums[offsets[1:]] - sums[offsets[:-1]]) / (n + SMOOTHING) + _squashed(figures) @ self.shares
        return np.where(figures.n_words > 0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))), 1.0)


def _parsed(column: pa.Array) -> tuple[Words, np.ndarray]:
    return words_of(column), text_bytes(column)[1]


def _squashed(figures: Shares) -> np.ndarray:
    """Shares in units of their bounds; those of too few words count as good."""
    poor_from, good_below, least = (np.array([labeller[k] for labeller in LABELLERS]) for k in (1, 2, 3))
    scaled = np.clip((figures.table - good_below) / (poor_from - good_below), -1, 2)
    return np.where(figures.n_words[:, None] >= least, scaled, -0.5)


def train_scorer(design: np.ndarray, scale: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Scorer:
    """Cross entropy to the posterior labels, by gradient steps over all sampled rows."""
    weights, first, second = np.zeros(design.shape[1]), np.zeros(design.shape[1]), np.zeros(design.shape[1])
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(design @ weights.astype(np.float32), -60, 60)))
        slope = design.T @ (p - target).astype(np.float32) / len(target) + decay * weights
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Scorer(float(weights[-1]), weights[:WIDTH] * scale, weights[WIDTH:-1])


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``pattern, n``: the vote patterns of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                patterns, n = np.unique(_names(votes(shares(*_parsed(part.column("text"))))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns.tolist(), pa.string()), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    found = docs.select("text").where("text is not null").mapInArrow(run, "pattern string, n bigint")
    return found.groupBy("pattern").agg(F.sum("n").alias("n"))


def _frequencies(features: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed features that each row has, their frequencies, and the rows' offsets; nothing is kept for absent ones."""
    per_row = np.diff(offsets)
    keys, counts = np.unique(np.repeat(np.arange(len(per_row)) * WIDTH, per_row) + features, return_counts=True)
    rows = keys // WIDTH
    shares = (counts / (per_row + SMOOTHING)[rows]).astype(np.float32)
    return (keys % WIDTH).astype(np.uint16), shares, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(per_row)))])


def _pieces(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring offsets, one row each."""
    data, ends = values.tobytes(), (offsets * values.itemsize).tolist()
    return pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())


def _sample(docs: DataFrame, total: int, rows: int) -> pa.Table:
    """Patterns, figures and frequencies of about ``rows`` different documents, chosen by a hash; never over twice as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, row_bytes = _parsed(part.column("text"))
                figures = shares(words, row_bytes)
                features, frequencies, offsets = _frequencies(*hashed(words, row_bytes))
                arrays = [
                    part.column("place"), pa.array(_names(votes(figures)), pa.string()),
                    pa.array([r.tobytes() for r in _squashed(figures)], pa.binary()), _pieces(features, offsets), _pieces(frequencies, offsets),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["place", "pattern", "figures", "features", "frequencies"])

    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    spread = 1 << 40
    chosen = docs.where("text is not null").select(place.alias("place"), "text").where(F.pmod("place", F.lit(spread)) < int(spread * min(1.0, rows / max(total, 1))))
    # Rows that repeat share their place: one of them stands for all, so that they neither fill nor change the sample.
    chosen = chosen.groupBy("place").agg(F.min("text").alias("text"))
    return chosen.mapInArrow(run, "place bigint, pattern string, figures binary, features binary, frequencies binary").limit(2 * rows).toArrow()


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Label model over all documents, then the scorer on the sample."""
    patterns = sorted((r.pattern, r.n) for r in vote_patterns(docs).collect())
    if not patterns:
        return Scorer(0.0, np.zeros(WIDTH), np.zeros(len(LABELLERS)))
    cast, counts = np.array([[int(v) for v in p] for p, _ in patterns]), np.array([n for _, n in patterns], float)
    model = fit_labels(cast, counts)
    sample = _sample(docs, int(counts.sum()), sample_rows).sort_by("place")
    target = model.posterior(np.array([[int(v) for v in p] for p in sample.column("pattern").to_pylist()]))
    return train_scorer(*_design(sample), target)


def _values(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """All values of a binary column, row after row, without a copy."""
    values = table.column(column).combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _design(sample: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A row of scaled frequencies, figures and a one per sampled document, and the frequencies' scale.

    The matrix is the one large array that the driver holds: it is filled from what the documents have, and scaled in place.
    """
    n = sample.num_rows
    design = np.zeros((n, WIDTH + len(LABELLERS) + 1), np.float32)
    sizes = pc.binary_length(sample.column("features")).to_numpy() // 2
    design[np.repeat(np.arange(n), sizes), _values(sample, "features", np.uint16)] = _values(sample, "frequencies", np.float32)
    design[:, WIDTH:-1] = _values(sample, "figures", np.float64).reshape(n, -1)
    design[:, -1] = 1
    scale = np.empty(WIDTH, np.float32)
    for first in range(0, WIDTH, _COLUMNS):
        some = design[:, first : min(first + _COLUMNS, WIDTH)]
        scale[first : first + _COLUMNS] = 1 / (some.std(axis=0) + 1e-3)
        some *= scale[first : first + _COLUMNS]
    return design, scale


def rate(docs: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, keep`` of every row of ``docs``."""
    scorer = scorer or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer.score(part.column("text")))], names=["doc_id", "score"])

    rated = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rated.withColumn("keep", F.col("score") >= threshold)


def reject_poor(docs: DataFrame, scorer: Scorer | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged."""
    scorer = scorer or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(scorer.score(part.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(read(spark, sf_dir, "documents"))
