"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words (white space apart, A-Z in lower case). A line
is removed if an earlier line, by ``doc_id`` and line number, has a Jaccard
similarity of 0.8 or more. Lines of the same words, each as often, are one class
with one first place; what follows joins classes.

1. Words are counted over the whole table in a histogram of hashes of fixed size;
   a set is ordered by rarity (that count, then the hash).
2. Two sets at the threshold share a word within their prefixes, the rarest
   ``n - ceil(0.8 n) + 1`` words. Each class posts its prefix words, with the
   word's position, the set's size and 128 parity bits of the set.
3. Under each word, in tiles of bounded size, the length filter, the positional
   filter and the parity bits (which never exceed the symmetric difference) leave
   few pairs. Only members of such pairs get their full sets sent.
4. In the same tiles those pairs are verified on the full sets, and the classes
   that have an earlier match are named. Pairs themselves are never emitted.

Defined results: null texts have no lines; lines without words match nothing and
stay. Null ``doc_id`` values come last. Rows of the same ``doc_id`` and text are
one document and keep the same lines. An empty table gives no rows. Extra columns
are ignored by ``decide`` and kept by ``remove_lines``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.groups import overlaps, runs, starts_of
from cueline.llm.tables import fresh, read, small
from cueline.llm.words import Words, mix, slices, words_of
from cueline.session import materialise

#: The threshold as a fraction of whole numbers, free of rounding.
PART, WHOLE = 4, 5
#: Buckets of the word histogram: a table of fixed size, whatever the input.
COUNT_BUCKETS = 1 << 16
#: Postings of one word in a tile, by expectation.
TILE_ROWS = 2048
#: Bits of the filter that says which lines' sets are wanted; of fixed size, and only a filter.
FILTER_BITS = 1 << 22
#: Upper bits of a key name the word (and tile), lower bits the set's size and the word's position.
_SIZE_BITS, _PLACE_BITS = 14, 12
_LOW = _SIZE_BITS + _PLACE_BITS
#: Bytes of a word's hash that the upper bits of a key take.
_WORD_BYTES = 5
#: Bits of a line's index in the number that words are sorted by.
_LINE_BITS = 22
_POSTING = ["key", "ref", "parity", "parity2", "side"]


def _ceil(n: np.ndarray | int, part: int, whole: int):
    return -(-n * part // whole)


class _Lines:
    """All lines of a slice, in order of row and line, with their words as they stand."""

    def __init__(self, column: pa.Array):
        lists = pc.split_pattern(pc.fill_null(column, ""), "\n")
        self.rows = pc.list_parent_indices(lists).to_numpy()
        sizes = pc.list_value_length(lists).to_numpy()
        self.numbers = np.arange(len(self.rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.all: Words = words_of(lists.flatten())
        self.n_words = np.diff(self.all.offsets)

    def digests(self) -> np.ndarray:
        """128 bits of the words of each line and how often each stands there, as two columns; no order is needed."""
        out = np.empty((len(self.rows), 2), np.uint64)
        for half, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.all.hashes * np.uint64(factor)))])
            out[:, half] = mix(sums[self.all.offsets[1:]] - sums[self.all.offsets[:-1]] + self.n_words.astype(np.uint64))
        return out

    def sets_of(self, lines: np.ndarray) -> list[bytes]:
        """The words' hashes of each of ``lines``, ascending and without repeats."""
        sizes, starts = self.n_words[lines], self.all.offsets[lines]
        inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owners, words = _distinct(np.repeat(np.arange(len(lines)), sizes), self.all.hashes[inside], np.zeros(1, np.uint64), len(lines))
        ends = np.cumsum(np.bincount(owners, minlength=len(lines))) * 8
        data = words.tobytes()
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def _distinct(lines: np.ndarray, hashes: np.ndarray, rank: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of the distinct words of each line, in order of line, rank and hash."""
    exact = n_lines > 1 << _LINE_BITS  # one long text of very short lines
    if not exact:
        # One number orders by line, rarity and most bits of the hash.
        packed = (lines.astype(np.uint64) << np.uint64(64 - _LINE_BITS)) | (rank << np.uint64(32)) | (hashes >> np.uint64(32))
        order = np.argsort(packed)
        packed = packed[order]
        same = np.flatnonzero(packed[1:] == packed[:-1])
        exact = (hashes[order[same]] != hashes[order[same + 1]]).any()  # the bits left out would decide
    if exact:
        order = np.lexsort((hashes, np.broadcast_to(rank, len(hashes)), lines))
    lines, hashes = lines[order], hashes[order]
    fresh_word = np.ones(len(hashes), bool)
    fresh_word[1:] = (hashes[1:] != hashes[:-1]) | (lines[1:] != lines[:-1])
    return lines[fresh_word], hashes[fresh_word]


class _Sets(_Lines):
    """The lines of a slice with their word sets in order of rarity."""

    def __init__(self, column: pa.Array, counts: np.ndarray | None):
        super().__init__(column)
        hashes = self.all.hashes
        rank = np.zeros(1, np.uint64) if counts is None else counts[(hashes & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)]
        lines, self.words = _distinct(self.all.rows(), hashes, rank, len(self.rows))
        self.sizes = np.bincount(lines, minlength=len(self.rows))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits in two numbers, each bit the parity of the number of words that hash to it."""
        bit, half = np.uint64(1) << (self.words >> np.uint64(58)), (self.words >> np.uint64(57)) & np.uint64(1)
        sums = [np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(half == h, bit, np.uint64(0)))]) for h in (0, 1)]
        return tuple(s[self.offsets[1:]] ^ s[self.offsets[:-1]] for s in sums)

    def prefix_sizes(self) -> np.ndarray:
        return np.where(self.sizes > 0, self.sizes - _ceil(self.sizes, PART, WHOLE) + 1, 0)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _place() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def word_ranks(docs: DataFrame) -> np.ndarray:
    """Words of all lines counted by hash bucket, as ranks: eighths of a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((words_of(part.column("text")).hashes & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), minlength=COUNT_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return (8 * np.log2(np.maximum(counts, 1))).astype(np.uint64)


def _firsts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct digest, and its rows."""
    order = np.lexsort((np.arange(len(digests)), digests[:, 1], digests[:, 0]))
    fresh_row = np.ones(len(order), bool)
    fresh_row[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(fresh_row)
    return order[starts], np.diff(np.append(starts, len(order)))


def line_classes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``d1, d2, at, n, size, parity, parity2, prefix``: each class of lines with its first place and its lines.

    ``prefix`` holds the upper ``_WORD_BYTES`` bytes of its words' hashes. Repeats within a slice are folded before the shuffle, so a very common line
    arrives once per slice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.sort_by([("doc_id", "ascending")]), "text"):
                sets = _Sets(part.column("text"), shared.value)
                digests = sets.digests()
                real = np.flatnonzero(sets.sizes)
                first, counts = _firsts(digests[real])
                lines = real[first]
                prefixes, starts = sets.prefix_sizes()[lines], sets.offsets[lines]
                inside = np.repeat(starts - (np.cumsum(prefixes) - prefixes), prefixes) + np.arange(prefixes.sum())
                data = np.ascontiguousarray(sets.words[inside].view(np.uint8).reshape(-1, 8)[:, 8 - _WORD_BYTES :])
                ends = np.concatenate([[0], np.cumsum(prefixes * _WORD_BYTES)]).astype(np.int32)
                prefix = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                arrays = [
                    _signed(digests[lines, 0]), _signed(digests[lines, 1]), part.column("doc_id").take(pa.array(sets.rows[lines])),
                    pa.array(sets.numbers[lines].astype(np.int32)), pa.array(counts), pa.array(sets.sizes[lines].astype(np.int32)),
                    *[_signed(p[lines]) for p in sets.parities()], prefix,
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["d1", "d2", "doc_id", "line", "n", "size", "parity", "parity2", "prefix"])

    found = docs.where("text is not null").select("doc_id", "text").mapInArrow(
        run, f"d1 bigint, d2 bigint, doc_id {kind}, line int, n bigint, size int, parity bigint, parity2 bigint, prefix binary"
    )
    # A struct of (is null, id, line) orders null ids last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line")).alias("at")
    # Shuffled as they are: slices have folded their repeats, and a second fold before the shuffle would sort for little.
    return found.repartition("d1", "d2").groupBy("d1", "d2").agg(first, F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("size", "parity", "parity2", "prefix")])


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all prefixes (upper bits of their hashes), and the row and the place of each."""
    sizes = pc.binary_length(batch.column("prefix")).to_numpy() // _WORD_BYTES
    data = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint8).reshape(-1, _WORD_BYTES)
    whole = np.zeros((len(data), 8), np.uint8)
    whole[:, 8 - _WORD_BYTES :] = data
    words = whole.view(np.uint64).ravel()
    return words, np.repeat(np.arange(len(sizes)), sizes), np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hot_words(classes: DataFrame, tile_rows: int) -> DataFrame:
    """``word, tiles`` of every word that may have over ``tile_rows`` postings.

    Such a word has ``tile_rows / partitions`` in some partition, so only words
    that reach this there are counted across partitions.
    """
    partitions = classes.rdd.getNumPartitions()
    least = max(1, tile_rows // max(1, partitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_words = [_prefixes(batch)[0] for batch in batches if batch.num_rows]
        if all_words:
            words, n = np.unique(np.concatenate(all_words), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(words[n >= least]), pa.array(n[n >= least])], names=["word", "n"])

    found = classes.select("prefix").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") > tile_rows).select("word", F.ceil((F.col("n") + tile_rows) / tile_rows).cast("int").alias("tiles"))


def _postings(classes: DataFrame, tile_rows: int) -> DataFrame:
    """``key, ref, parity, parity2, side``: prefix words of all classes, in pairs of tiles where a word is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words, rows, places = _prefixes(batch)
            sizes = batch.column("size").to_numpy()
            low = (np.minimum(sizes[rows], (1 << _SIZE_BITS) - 1) << _PLACE_BITS) | np.minimum(places, (1 << _PLACE_BITS) - 1)
            key = ((words >> np.uint64(_LOW)) << np.uint64(_LOW)) | low.astype(np.uint64)
            arrays = [_signed(words), _signed(key), *[batch.column(c).take(pa.array(rows)) for c in ("d1", "parity", "parity2")]]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "key", "ref", "parity", "parity2"])

    plain = classes.select("d1", "size", "parity", "parity2", "prefix").mapInArrow(
        run, "word bigint, key bigint, ref bigint, parity bigint, parity2 bigint"
    )
    hot = materialise(_hot_words(classes, tile_rows), "line-hot-words")
    n_hot = hot.count()
    if n_hot == 0:
        return plain.select("key", "ref", "parity", "parity2", F.lit(0).cast("byte").alias("side"))
    met = plain.join(small(hot.withColumnRenamed("word", "w"), n_hot), F.col("word") == F.col("w"), "left")
    dealt = met.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("ref"), F.col("tiles")).cast("int"))
    paired = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # The tile pair becomes part of the word's bits; side: 0 within one tile, 1 and 2 across two.
    tile_pair = F.xxhash64("word", F.least("tile", "partner"), F.greatest("tile", "partner"))
    mask = (1 << _LOW) - 1
    key = F.when(F.col("tiles") == 1, F.col("key")).otherwise(tile_pair.bitwiseAND(F.lit(~mask)).bitwiseOR(F.col("key").bitwiseAND(F.lit(mask))))
    side = F.when(F.col("tile") == F.col("partner"), 0).when(F.col("tile") < F.col("partner"), 1).otherwise(2)
    return paired.select(key.alias("key"), "ref", "parity", "parity2", side.cast("byte").alias("side"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of a word together, in order of the size of their sets."""
    return rows.repartition(F.shiftright("key", _LOW)).sortWithinPartitions("key")


def _words_of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole words from grouped postings, with a column of the word's bits."""
    named = (b.append_column("word", pa.array(b.column("key").to_numpy() >> _LOW)) for b in batches)
    return runs(named, ["word"])


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one word that pass the length, positional and parity filters.

    Within a word rows are ordered by size, so a row that is too small for the
    one ``lag`` rows on is too small for all behind it.
    """
    word, key, side = (table.column(c).to_numpy() for c in ("word", "key", "side"))
    parities = [table.column(c).to_numpy().view(np.uint64) for c in ("parity", "parity2")]
    low = key & ((1 << _LOW) - 1)
    size, place = low >> _PLACE_BITS, low & ((1 << _PLACE_BITS) - 1)
    capped = (size == (1 << _SIZE_BITS) - 1) | (place == (1 << _PLACE_BITS) - 1)
    rest = np.where(capped, 1 << 40, size - place)
    group_end = np.searchsorted(word, word, "right")
    split, left, lag = side.any(), np.arange(len(word)), 0
    while True:
        lag += 1
        left = left[left + lag < group_end[left]]
        left = left[WHOLE * size[left] >= PART * size[left + lag]]
        if not len(left):
            return
        needed = _ceil(size[left] + size[left + lag], PART, PART + WHOLE)
        near = np.minimum(rest[left], rest[left + lag]) >= needed
        if split:
            near &= (side[left] == 0) | (side[left] != side[left + lag])
        a, needed = left[near], needed[near]
        b = a + lag
        apart = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in parities)
        near = (apart <= size[a] + size[b] - 2 * needed) | capped[a] | capped[b]
        if near.any():
            yield a[near], b[near]


def _met(postings: DataFrame) -> DataFrame:
    """The postings that have a pair to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _words_of_postings(batches):
            wanted = np.zeros(table.num_rows, bool)
            for left, right in _pairs(table):
                wanted[left] = wanted[right] = True
            yield from table.select(_POSTING).filter(pa.array(wanted)).to_batches()

    return _grouped(postings).mapInArrow(run, postings.schema)


def _first_met(met: DataFrame) -> DataFrame:
    """The postings of ``met`` (with ``prefix``) that have a pair under the first word that the two share.

    Similar lines meet under nearly every prefix word; one meeting is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _words_of_postings(batches):
            places = (table.column("key").to_numpy() & ((1 << _PLACE_BITS) - 1)).tolist()
            earlier = [
                frozenset(p[i : i + _WORD_BYTES] for i in range(0, place * _WORD_BYTES, _WORD_BYTES))
                for p, place in zip(table.column("prefix").to_pylist(), places)
            ]
            wanted = np.zeros(table.num_rows, bool)
            for left, right in _pairs(table):
                first = [earlier[a].isdisjoint(earlier[b]) for a, b in zip(left.tolist(), right.tolist())]
                wanted[left[first]] = wanted[right[first]] = True
            yield from table.select(_POSTING).filter(pa.array(wanted)).to_batches()

    return _grouped(met).mapInArrow(run, met.select(_POSTING).schema)


def _filter(rows: DataFrame, column: str):
    """Broadcast bits of a column's values: whatever is in ``rows`` passes, little else while they are few."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    marked = np.zeros(FILTER_BITS, bool)
    marked[rows.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    return rows.sparkSession.sparkContext.broadcast(np.packbits(marked))


def _passing(wanted: np.ndarray, found: _Lines, digests: np.ndarray) -> np.ndarray:
    """Lines of a slice that have words and pass a filter."""
    return np.flatnonzero(wanted[(digests[:, 0] & np.uint64(FILTER_BITS - 1)).astype(np.int64)] & (found.n_words > 0))


def _full_sets(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """``d1, d2, words`` of lines that may be wanted: all those that pass a filter of fixed size."""
    shared = _filter(refs, "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _Lines(part.column("text"))
                digests = found.digests()
                lines = _passing(wanted, found, digests)
                lines = lines[_firsts(digests[lines])[0]]
                yield pa.RecordBatch.from_arrays([_signed(digests[lines, 0]), _signed(digests[lines, 1]), pa.array(found.sets_of(lines), pa.binary())], names=["d1", "d2", "words"])

    return docs.where("text is not null").select("text").mapInArrow(run, "d1 bigint, d2 bigint, words binary")


def _later(met: DataFrame) -> DataFrame:
    """``d1, d2`` of classes that an earlier class of the same tile matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _words_of_postings(batches):
            found = list(_pairs(table))
            if not found:
                continue
            left, right = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            at = table.column("at").combine_chunks()
            numbers = table.append_column("unnamed", at.field("unnamed")).append_column("id", at.field("doc_id")).append_column("line", at.field("line"))
            order = pc.sort_indices(numbers, sort_keys=[(k, "ascending") for k in ("unnamed", "id", "line", "d1", "d2")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            starts = np.append(starts_of(table, ["word"]), table.num_rows)
            group = np.searchsorted(starts, left, "right") - 1
            later = np.zeros(table.num_rows, bool)
            words = table.column("words").to_pylist()
            by_group = np.argsort(group, kind="stable")
            left, right, group = left[by_group], right[by_group], group[by_group]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                first, last = int(starts[group[a]]), int(starts[group[a] + 1])
                sets = [np.frombuffer(w, np.uint64) for w in words[first:last]]
                x, y = left[a:b] - first, right[a:b] - first
                both, sizes = overlaps(sets, x, y), np.array([len(s) for s in sets])
                match = both * WHOLE >= PART * (sizes[x] + sizes[y] - both)
                pair = np.stack([x[match], y[match]]) + first
                later[np.where(rank[pair[0]] > rank[pair[1]], pair[0], pair[1])] = True
            yield from table.select(["d1", "d2"]).filter(pa.array(later)).to_batches()

    return _grouped(met).mapInArrow(run, "d1 bigint, d2 bigint")


def removed_lines(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``place, lines``: the numbers (from 0) of removed lines, by the key of (doc_id, text)."""
    classes = materialise(line_classes(docs, word_ranks(docs)), "line-classes")
    found = _met(_postings(classes, tile_rows)).join(classes.select(F.col("d1").alias("d"), "prefix"), F.col("ref") == F.col("d"))
    met = materialise(_first_met(found.select(*_POSTING, "prefix")), "line-met")
    refs = materialise(met.select("ref").distinct(), "line-refs")
    named = refs.join(classes.select("d1", "d2", "at"), F.col("ref") == F.col("d1"))
    sets = _full_sets(docs, refs).select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), "words")
    whole = named.join(sets, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2"))).select("d1", "d2", "at", "words").dropDuplicates(["d1", "d2"])
    later = materialise(_later(met.join(whole, F.col("ref") == F.col("d1"))).distinct(), "line-later")
    return _occurrences(docs, classes, later)


def _occurrences(docs: DataFrame, classes: DataFrame, later: DataFrame) -> DataFrame:
    """``place, lines`` from the classes that lose lines: those of several lines, and those with an earlier match."""
    late = classes.select("d1", "d2", "at", "n").join(later.withColumn("late", F.lit(True)), ["d1", "d2"], "left")
    losing = materialise(late.where("n > 1 or late"), "line-losing")
    shared = _filter(losing, "d1")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                found = _Lines(part.column("text"))
                digests = found.digests()
                lines = _passing(wanted, found, digests)
                rows = pa.array(found.rows[lines])
                arrays = [_signed(digests[lines, 0]), _signed(digests[lines, 1]), part.column("doc_id").take(rows), part.column("place").take(rows), pa.array(found.numbers[lines].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["d1", "d2", "doc_id", "place", "line"])

    lines = docs.where("text is not null").select("doc_id", _place().alias("place"), "text").mapInArrow(
        run, f"d1 bigint, d2 bigint, doc_id {kind}, place bigint, line int"
    )
    known = losing.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "at", "late")
    gone = F.col("late") | ~(F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("line") == F.col("at.line")))
    return (
        lines.join(known, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2"))).where(F.coalesce(gone, F.lit(False)))
        .groupBy("place").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def decide(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every row of ``docs``; line numbers from 0."""
    removed = removed_lines(docs, tile_rows).withColumnRenamed("place", "p")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))  # far cheaper than to split the text
    rows = docs.select("doc_id", _place().alias("place"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return rows.join(removed, F.col("place") == F.col("p"), "left").select(
        "doc_id", "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed")
    )


def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers, in one walk over each."""

    def cut(text: str, gone: np.ndarray) -> str:
        pieces = np.array(text.split("\n"), object)
        return "\n".join(np.delete(pieces, gone))

    return pd.Series([None if text is None else cut(text, gone) for text, gone in zip(texts, numbers)], dtype=object)


def remove_lines(docs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; columns unchanged."""
    place, lines = fresh(docs, "line_place", "line_numbers")
    removed = removed_lines(docs, tile_rows).select(F.col("place").alias(place), F.col("lines").alias(lines))
    joined = docs.join(removed, _place() == F.col(place), "left")
    cut = F.pandas_udf(_without, "string")
    kept = cut(F.when(F.col(lines).isNotNull(), F.col("text")), F.col(lines))
    return joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"))
