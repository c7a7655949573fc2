"""Token counts of whole texts by a map-side lookup in two tiers.

A byte-level BPE tokenizer first cuts a text into pre-tokens, and merges never
cross their edges. A text's count is therefore a sum of the lengths of its
pre-tokens, and equal pre-tokens have equal lengths.

* First tier: one pass over all texts counts pre-tokens inside each task, in a
  summary of bounded size; the summaries' heaviest entries are added up, and the
  most frequent pre-tokens with their lengths are broadcast as one buffer of
  bytes and one array of numbers (``TABLE_SIZE`` entries of ``LONGEST`` characters
  at most, so the bound holds for any input).
* Second tier: a pre-token that is not there is encoded by the library once and
  kept in the Python worker, across batches and tasks, up to ``CACHE_SIZE``.

Pre-tokens are never shuffled: only the summaries are, ``TASK_ENTRIES`` rows of a
task at most. What they hold decides how often the library is asked, never a
count: every length is the library's own.

Special strings count as the library handles them by default. Which letters,
numbers and spaces a pattern knows depends on the Unicode version, so texts with
code points that are unassigned here are encoded whole, cut where a space between
two ASCII letters makes the edge certain.

Defined results: null counts as the empty text (0 bytes, 0 tokens). A text of any
length is counted in pieces of bounded memory. Repeated rows are counted each. An
empty table gives no rows. Other columns are returned unchanged; where they have
a name of this operator's columns, the latter gets underscores.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.tables import fresh, read
from cueline.llm.words import slices

LIMIT = 1024
#: Entries of the broadcast table, and characters of its longest.
TABLE_SIZE, LONGEST = 1 << 15, 64
#: Distinct pre-tokens that a task counts at once, and the heaviest that it reports.
SUMMARY_SIZE, TASK_ENTRIES = 1 << 17, 1 << 12
#: Pre-tokens that a worker keeps.
CACHE_SIZE = 1 << 18
#: Characters from which a text is cut lazily, and pre-tokens counted at once.
_LONG, _RUN = 1 << 20, 1 << 16

# Fixed value: the pattern of byte-level pre-tokenizers.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Bytes that byte-level vocabularies write as the character of their number; the
# others are written as the characters from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_AS_BYTES = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}

_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def default_path() -> str:
    """The file of the default tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _unassigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def _uncertain(text: str) -> bool:
    """Whether the text has code points whose class depends on the Unicode version."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def _cut(text: str) -> Iterator[str]:
    """Pieces of about ``_LONG`` characters, cut only where pre-tokens surely end."""
    first = 0
    while len(text) - first > _LONG:
        edge = _SAFE.search(text, first + _LONG)
        if edge is None:
            break
        yield text[first : edge.start()]
        first = edge.start()
    yield text[first:]


class Encoder:
    """The library's tokenizer of one file, and how its texts are cut into pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        spec = json.loads(self._library.to_str())
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        #: Whether texts can be cut here; otherwise the library encodes them whole.
        self.cuts = bool(plain and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"))
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        self._pattern = regex.compile(PRE_TOKEN)

    def lengths(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text, by the library."""
        return [len(e.ids) for e in self._library.encode_batch(list(texts), add_special_tokens=False)]

    def piece_lengths(self, pieces: Iterable[str]) -> list[int]:
        """Tokens of each pre-token, by the library's model alone."""
        tokenize = self._library.model.tokenize
        return [len(tokenize(p.encode().decode("latin-1").translate(_AS_BYTES))) for p in pieces]

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """The number of special strings in a text, and the texts between them."""
        if self._special is None or self._special.search(text) is None:
            return 0, [text]
        parts = self._special.split(text)
        return len(parts) - 1, parts

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, in runs of bounded size."""
        if len(text) <= _LONG:
            yield self._pattern.findall(text)
            return
        found = (m.group() for m in self._pattern.finditer(text))
        while run := list(islice(found, _RUN)):
            yield run


class Lengths(dict):
    """Lengths of frequent pre-tokens; asks for all others in the worker's cache."""

    def __init__(self, encoder: Encoder, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encoder, self.kept, self.rest = encoder, {}, {}

    def __missing__(self, piece: str) -> int:
        n = self.kept.get(piece)
        return self.rest[piece] if n is None else n

    def learn(self, runs: list[list[str]]) -> None:
        """Encode the pre-tokens of ``runs`` that no tier has."""
        new = list(set().union(*runs).difference(self, self.kept))
        if len(self.kept) + len(new) > CACHE_SIZE:
            self.kept, new = {}, list(set().union(*runs).difference(self))
        self.rest = {}
        for piece, n in zip(new, self.encoder.piece_lengths(new)):
            (self.kept if len(piece) <= LONGEST else self.rest)[piece] = n

    def total(self, run: list[str]) -> int:
        return sum(map(self.__getitem__, run))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals, runs, owners = [0] * len(texts), [], []
        for row, text in enumerate(texts):
            if not self.encoder.cuts:
                totals[row] = self.encoder.lengths([text])[0]
            elif _uncertain(text):
                totals[row] = sum(self.encoder.lengths([piece])[0] for piece in _cut(text))
            else:
                totals[row], parts = self.encoder.pieces(text)
                for part in parts:
                    if len(part) > _LONG:
                        for run in self.encoder.pre_tokens(part):
                            self.learn([run])
                            totals[row] += self.total(run)
                    else:
                        runs += self.encoder.pre_tokens(part)
                        owners.append(row)
        self.learn(runs)
        for row, run in zip(owners, runs):
            totals[row] += self.total(run)
        return totals


@cache
def _encoder(path: str | None) -> Encoder:
    return Encoder(path or default_path())


_workers: dict = {}


def _lengths(path: str | None, key: tuple, packed: tuple[bytes, np.ndarray]) -> Lengths:
    """The two tiers of this worker; the cache of misses outlives the task."""
    if key not in _workers:
        blob, lengths = packed
        kept = next(iter(_workers.values())).kept if _workers and next(iter(_workers))[0] == path else {}
        _workers.clear()
        _workers[key] = Lengths(_encoder(path), dict(zip(blob.decode().split("\0"), lengths.tolist())) if len(lengths) else {})
        _workers[key].kept = kept
    return _workers[key]


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def frequent_pre_tokens(docs: DataFrame, path: str | None = None, column: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """The pre-tokens that occur most in all texts, with their lengths in tokens.

    Every task counts in a summary of ``SUMMARY_SIZE`` entries, which drops its
    lighter half when it is full, and reports its ``TASK_ENTRIES`` heaviest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(path), Counter()
        if not encoder.cuts:
            return
        for batch in batches:
            for part in slices(batch, column):
                for text in _texts(part.column(column)):
                    for piece in encoder.pieces(text)[1]:
                        for found in encoder.pre_tokens(piece):
                            seen.update(found)
                            if len(seen) > SUMMARY_SIZE:
                                seen = Counter(dict(seen.most_common(SUMMARY_SIZE // 2)))
        best = [(p, n) for p, n in seen.most_common(TASK_ENTRIES) if n > 1 and len(p) <= LONGEST and "\0" not in p]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    found = docs.select(column).mapInArrow(run, "piece string, n bigint")
    best = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "piece").limit(size)
    pieces = [r.piece for r in best.select("piece").collect()]
    return dict(zip(pieces, _encoder(path).piece_lengths(pieces))) if pieces else {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, column: str = "text", frequent: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is the tokenizer's file, which every executor has; ``frequent`` replaces the pass
    that finds the first tier.
    """
    if frequent is None:
        frequent = frequent_pre_tokens(docs, path, column)
    packed = "\0".join(frequent).encode(), np.array(list(frequent.values()), np.uint16)
    table = docs.sparkSession.sparkContext.broadcast(packed)
    key = path, uuid.uuid4().hex
    n_bytes, n_tokens, over = fresh(docs, "n_bytes", "n_tokens", "over_limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, key, table.value)
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column)
                tokens = np.array(lengths.count(_texts(texts)), np.int64)
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, sizes, pa.array(tokens), pa.array(tokens > limit)], names=[*part.schema.names, n_bytes, n_tokens, over])

    added = [T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType()), T.StructField(over, T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
