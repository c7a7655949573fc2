"""Join of near-duplicate texts: MinHash bands find candidates, full n-gram sets verify them.

A text's set is its runs of five words (white space apart, A-Z in lower case; a
shorter text is one run), as 64-bit hashes. Two texts are linked if the Jaccard
similarity of their sets is 0.8 or more.

1. Texts of the same words are one class; what follows is about classes.
2. Each class has a signature of MinHash bytes. ``choose_bands`` takes as many
   rows a band as the hashes allow while a pair at the threshold still meets in
   some band with the target recall. Classes are shuffled by the bytes of each
   band; groups of two or more meet in tiles of bounded size.
3. In a tile, signatures alone tell which pairs meet here first (no earlier band
   in common) and may be similar at all (their estimate is not far below the
   threshold). Only members of such pairs get their texts sent.
4. In the same tiles, those pairs are verified on the full sets. A tile returns
   the number of links of each member and its component within the tile, never
   the pairs themselves, so large groups of near copies stay linear in rows.
5. Components across tiles follow by contraction.

Defined results: texts without words (null, empty, blank) have no set, link to
nothing and are each their own class. Rows without ``doc_id``, and several texts
under one ``doc_id``, are rated and decided like others; null ids come last. Of
repeated rows one stays. An empty table gives no rows. Extra columns are ignored
by ``link`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.groups import components, local_roots, overlaps, runs, starts_of, tiled
from cueline.llm.tables import fresh, read
from cueline.llm.words import mix, shingles_of, slices, words_of
from cueline.session import materialise

N_GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Hashes of a signature at most.
HASHES = 128
#: Standard errors below the threshold from which on an estimate rules a pair out.
DOUBT = 5.5
#: Members and words of a tile, by expectation.
TILE_ROWS, TILE_WORDS = 1024, 2_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most selective pair of numbers that has the recall."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold + 1e-12))), 1)
    for rows in range(2, 8):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes and bands < 256:
            best = (bands, rows)
    return best


BANDS, ROWS = choose_bands()
_RANDOM = np.random.default_rng(88)
_FLIP = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FACTOR = _RANDOM.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGEST = _RANDOM.integers(0, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(shingles: np.ndarray, offsets: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """One byte for each hash of each row: bits of the row's smallest hashed n-gram."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, hashes), np.uint8)
    work = np.empty_like(shingles)
    for k in range(hashes if len(full) else 0):
        np.bitwise_xor(shingles, _FLIP[k], out=work)
        np.multiply(work, _FACTOR[k], out=work)
        out[full, k] = (mix(np.minimum.reduceat(work, offsets[full])) >> np.uint64(56)).astype(np.uint8)
    return out


def _digests(shingles: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's sequence of n-grams; none for rows without words."""
    place = np.arange(len(shingles)) - np.repeat(offsets[:-1], np.diff(offsets))
    halves = []
    for factor in _DIGEST:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + place.astype(np.uint64) * factor))])
        halves.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + n_words.astype(np.uint64) * factor))
    both = np.column_stack(halves).astype(">u8")
    return [row.tobytes() if n else None for row, n in zip(both, n_words.tolist())]


def _row_key():
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, place, digest, n_words, signature`` of every row; ``place`` finds the text again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                shingles, offsets = shingles_of(words, N_GRAM)
                n_words = np.diff(words.offsets)
                signature = [r.tobytes() for r in signatures(shingles, offsets)]
                arrays = [part.column("doc_id"), part.column("place"), pa.array(_digests(shingles, offsets, n_words), pa.binary()), pa.array(n_words), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "place", "digest", "n_words", "signature"])

    given = docs.select("doc_id", _row_key().alias("place"), "text")
    return given.mapInArrow(run, f"doc_id {kind}, place bigint, digest binary, n_words bigint, signature binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """``bucket, digest, n_words`` for each band of each class; the band is the key's upper part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            signature = _matrix(batch.column("signature"))
            keys = np.zeros((batch.num_rows, BANDS), np.int64)
            for i in range(ROWS):
                keys = (keys << 8) | signature[:, i::ROWS][:, :BANDS]
            keys |= np.arange(BANDS, dtype=np.int64) << 56
            repeated = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("digest").take(repeated), batch.column("n_words").take(repeated)], names=["bucket", "digest", "n_words"])

    return nodes.select("digest", "n_words", "signature").mapInArrow(run, "bucket bigint, digest binary, n_words bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _first_meetings(signature: np.ndarray, tile: np.ndarray, band: int, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a tile pair that meet here first and may be similar."""
    n, hashes = signature.shape
    least = (THRESHOLD - DOUBT * math.sqrt(THRESHOLD * (1 - THRESHOLD) / hashes)) * hashes
    # Bytes of one band side by side, so that bands compare as runs.
    by_band = signature[:, np.arange(BANDS * ROWS).reshape(BANDS, ROWS)]
    left, right = [], []
    step = max(1, (8 << 20) // max(1, n * hashes))
    for first in range(0, n, step):
        i = np.arange(first, min(first + step, n))
        same = signature[i][:, None, :] == signature[None, :, :]
        near = same.sum(axis=2) >= least
        near &= (tile[i][:, None] != tile[None, :]) if cross else True
        a, b = np.nonzero(near & (i[:, None] < np.arange(n)[None, :]))
        a = i[a]
        if band:
            earlier = (by_band[a, :band] == by_band[b, :band]).all(axis=2).any(axis=1)
            a, b = a[~earlier], b[~earlier]
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


_TILE = ["bucket", "low", "high"]


def _met(tiles: DataFrame) -> DataFrame:
    """The rows of ``tiles`` whose member has a pair to verify in its tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _TILE):
            starts = np.append(starts_of(table, _TILE), table.num_rows)
            signature, tile = _matrix(table.column("signature").combine_chunks()), table.column("tile").to_numpy()
            bands, cross = table.column("bucket").to_numpy() >> 56, table.column("low").to_numpy() != table.column("high").to_numpy()
            wanted = np.zeros(table.num_rows, bool)
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if last - first > 1:
                    a, b = _first_meetings(signature[first:last], tile[first:last], int(bands[first]), bool(cross[first]))
                    wanted[first + a] = wanted[first + b] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    return _by_tile(tiles).mapInArrow(run, tiles.schema)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE)


def _verified(met: DataFrame) -> DataFrame:
    """``digest, root, texts, docs``: verified links of each member within its tile, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _TILE):
            starts = np.append(starts_of(table, _TILE), table.num_rows)
            tile, copies, digests = table.column("tile").to_numpy(), table.column("copies").to_numpy(), table.column("digest").to_pylist()
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = table.slice(first, last - first)
                band, cross = group.column("bucket")[0].as_py() >> 56, group.column("low")[0].as_py() != group.column("high")[0].as_py()
                left, right = _first_meetings(_matrix(group.column("signature").combine_chunks()), tile[first:last], band, cross)
                shingles, offsets = shingles_of(words_of(group.column("text").combine_chunks()), N_GRAM)
                sets = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                both = overlaps(sets, left, right)
                sizes = np.array([len(s) for s in sets])
                # The threshold as a fraction of whole numbers, free of rounding.
                linked = both * 10_000 >= round(THRESHOLD * 10_000) * (sizes[left] + sizes[right] - both)
                left, right = left[linked], right[linked]
                if not len(left):
                    continue
                n = last - first
                texts = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
                mine = copies[first:last]
                docs = np.bincount(left, mine[right], n) + np.bincount(right, mine[left], n)
                root = local_roots(n, left, right)
                some = np.flatnonzero(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[first + i] for i in some], pa.binary()), pa.array([digests[first + root[i]] for i in some], pa.binary()), pa.array(texts[some].astype(np.int64)), pa.array(docs[some].astype(np.int64))],
                    names=["digest", "root", "texts", "docs"],
                )

    return _by_tile(met).mapInArrow(run, "digest binary, root binary, texts bigint, docs bigint")


def _connected(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signed`` rows, and ``digest, lowest, copies, texts, docs, root`` of each class of equal words.

    Classes that links connect share the ``root``. ``lowest`` is the first row
    of the class: its struct (is null, id, place) orders null ids last.
    """
    members = materialise(signed(docs), "minhash-members")
    nodes = materialise(
        members.where("digest is not null").groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")).alias("lowest"), F.count(F.lit(1)).alias("copies"),
            F.first("n_words").alias("n_words"), F.first("signature").alias("signature"),
        ),
        "minhash-nodes",
    ).withColumn("place", F.col("lowest.place"))
    tiles = tiled(_buckets(nodes), "bucket", "digest", F.col("n_words"), TILE_ROWS, TILE_WORDS)
    signature = nodes.select(F.col("digest").alias("d"), "copies", "place", "signature")
    met = materialise(
        _met(tiles.join(signature, F.col("digest") == F.col("d")).select("bucket", "low", "high", "tile", "digest", "copies", "place", "signature")),
        "minhash-met",
    )
    # One text of each place, folded before the shuffle: a row may repeat in a third of the table.
    texts = docs.select(_row_key().alias("p"), "text").groupBy("p").agg(F.first("text").alias("text"))
    wanted = met.select("digest", "place").distinct()
    found = wanted.join(texts, F.col("place") == F.col("p")).select(F.col("digest").alias("d"), "text")
    links = materialise(
        _verified(met.join(found, F.col("digest") == F.col("d")).select("bucket", "low", "high", "tile", "digest", "copies", "signature", "text")),
        "minhash-links",
    )
    roots = components(links.select(F.col("digest").alias("left"), F.col("root").alias("right")), "minhash")
    counts = links.groupBy("digest").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    known = (
        nodes.select("digest", "lowest", "copies")
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left").join(counts, "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    return members, known


def _firsts(known: DataFrame) -> DataFrame:
    """``r, first``: the first row of the classes of each root."""
    return known.groupBy(F.col("root").alias("r")).agg(F.min("lowest").alias("first"))


def link_keyed(docs: DataFrame) -> DataFrame:
    """``link`` with ``class_key``, which names the class where ``class_id`` is null or shared by classes."""
    members, known = _connected(docs)
    rated = known.join(_firsts(known), F.col("root") == F.col("r")).select(
        F.col("digest").alias("d"), F.col("first.doc_id").alias("class_id"), F.lower(F.hex("root")).alias("class_key"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
    )
    wordless = F.col("digest").isNull()
    return members.select("doc_id", "place", "digest").join(rated, F.col("digest") == F.col("d"), "left").select(
        "doc_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"),
        F.when(wordless, F.lower(F.hex("place"))).otherwise(F.col("class_key")).alias("class_key"),
    )


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, n_linked_texts`` of every row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` of the texts that links connect,
    ``n_links`` the number of other rows at the threshold or above, copies
    included, and ``n_linked_texts`` that of other classes of equal words.
    """
    return link_keyed(docs).drop("class_key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id`` (null: last) and place; columns unchanged."""
    row, key = fresh(docs, "row_place", "kept_place")
    members, known = _connected(docs)
    kept = _firsts(known).select(F.col("first.place").alias(key)).union(members.where("digest is null").select("place")).distinct()
    # Repeated rows are folded first, as all rows of one place meet in one task.
    rows = docs.dropDuplicates(["doc_id", "text"]).withColumn(row, _row_key())
    return rows.join(kept, F.col(row) == F.col(key), "left_semi").drop(row)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_keyed(read(spark, sf_dir, "documents"))
