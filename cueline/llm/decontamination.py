"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ten consecutive words of a benchmark item is a test string; an item
of fewer words is one string. The symbols of the search are words. Strings of
one length ``n`` share a shift table: the hash of the block of words that ends at
a text position says how far the next possible end of a string is, so impossible
positions are skipped. Where the shift is 0, the strings that end in this block
(a bucket) are compared with the text, first word hash by word hash, then byte by
byte.

All rows of a slice are searched at once: long texts are dealt into lanes, each
lane has its own position, and one numpy step moves all lanes.

Defined results: null and empty texts have no words and are clean. Null
benchmark texts are skipped; an item with a null id marks words but is not
listed. An empty benchmark leaves all documents clean, an empty table gives no
rows. Null and repeated ``doc_id`` values are rows like any other. Extra columns
are ignored by ``scan`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.tables import read
from cueline.llm.words import ALPHANUMERIC, FOLD, Words, mix, slices, words_of

WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 3
#: Text ends that one lane of the search covers.
LANE = 256
#: Expected most bytes of benchmark texts and ids in one pass; a larger benchmark is searched in several.
PASS_BYTES = 4 << 20


class Strings(NamedTuple):
    """All test strings of one length, in the order of the hash of their last block."""

    length: int
    first: np.ndarray  # number of the first word
    suffixes: np.ndarray
    shifts: np.ndarray
    offsets: np.ndarray  # string ``i`` stands in ``rows[offsets[i]:offsets[i + 1]]``
    rows: np.ndarray


class Compiled(NamedTuple):
    """One pass of the benchmark: its words in one buffer, joined by single spaces, and the strings over them.

    Nothing but numbers is held per word and string: some 10 bytes for each byte of text.
    """

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ids: list[list[str]]  # of each row
    strings: list[Strings]

    def bytes_of(self, first: int, last: int) -> bytes:
        return self.text[self.starts[first] : self.ends[last - 1]]


def _blocks(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of ``width`` words that ends at each of ``ends``."""
    total = hashes[ends].copy()
    for i in range(1, width):
        total = mix(total) + hashes[ends - i] * np.uint64(2 * i + 1)
    return mix(total)


def compile_strings(items: list[tuple[list[str], str | None]], window: int = WINDOW) -> Compiled:
    """Test strings of ``(item ids, text)`` rows with their shift tables."""
    words = words_of(pa.array([text for _, text in items], pa.string()), ALPHANUMERIC)
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.full(int(ends[-1]) + 1 if len(ends) else 0, ord(" "), np.uint8)
    if len(ends):
        text[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = FOLD[words.data[ALPHANUMERIC[words.data]]]
    compiled = Compiled(text.tobytes(), starts.astype(np.int32), ends.astype(np.int32), words.hashes, [ids for ids, _ in items], [])
    counts = np.diff(words.offsets)
    lengths = np.minimum(counts, window)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        each = counts[rows] - length + 1
        first = np.repeat(words.offsets[rows] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        compiled.strings.append(_compile(compiled, length, first, np.repeat(rows, each)))
    return compiled


def _compile(compiled: Compiled, length: int, first: np.ndarray, rows: np.ndarray) -> Strings:
    """Strings of ``length`` words from the places where they stand; equal ones are one string."""
    hashes, width = compiled.hashes, min(BLOCK, length)
    suffixes, wholes = _blocks(hashes, first + length - 1, width), _blocks(hashes, first + length - 1, length)
    order = np.lexsort((rows, wholes, suffixes))
    first, rows, suffixes, wholes = first[order], rows[order], suffixes[order], wholes[order]
    new = np.ones(len(first), bool)
    new[1:] = (suffixes[1:] != suffixes[:-1]) | (wholes[1:] != wholes[:-1])
    for i in np.flatnonzero(~new).tolist():  # equal hashes: the bytes decide
        new[i] = compiled.bytes_of(first[i], first[i] + length) != compiled.bytes_of(first[i - 1], first[i - 1] + length)
    # Windows overlap, so there are hardly more blocks than words.
    size = 1 << max(12, int(8 * (len(first) + length)).bit_length())
    shifts = np.full(size, length - width + 1, np.min_scalar_type(length - width + 1))
    heads = first[new]
    for end in range(width - 1, length):
        np.minimum.at(shifts, _blocks(hashes, heads + end, width) & np.uint64(size - 1), shifts.dtype.type(length - 1 - end))
    string = np.cumsum(new) - 1
    fresh_row = new.copy()
    fresh_row[1:] |= rows[1:] != rows[:-1]
    offsets = np.searchsorted(string[fresh_row], np.arange(len(heads) + 1))
    return Strings(length, heads.astype(np.int32), suffixes[new], shifts, offsets.astype(np.int32), rows[fresh_row].astype(np.int32))


def _candidates(words: Words, strings: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Ends of text and strings that may end there, found by skipping."""
    length, width = strings.length, min(BLOCK, strings.length)
    first, last = words.offsets[:-1] + length - 1, words.offsets[1:]
    lanes = np.maximum(0, -(-(last - first) // LANE))
    at = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    until = np.minimum(at + LANE, np.repeat(last, lanes))
    mask, ends, blocks = np.uint64(len(strings.shifts) - 1), [], []
    while len(at):
        block = _blocks(words.hashes, at, width)
        shift = strings.shifts[block & mask].astype(np.int64)
        stop = shift == 0
        if stop.any():
            ends.append(at[stop])
            blocks.append(block[stop])
        at = at + np.maximum(shift, 1)
        going = at < until
        at, until = at[going], until[going]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, block = np.concatenate(ends), np.concatenate(blocks)
    low, high = np.searchsorted(strings.suffixes, block, "left"), np.searchsorted(strings.suffixes, block, "right")
    count = high - low
    place = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(end, count), place


def _occurrences(words: Words, compiled: Compiled, strings: Strings) -> Iterator[tuple[int, int]]:
    """``(first word, string)`` of every occurrence."""
    end, place = _candidates(words, strings)
    first = end - strings.length + 1
    for i in range(strings.length):
        same = words.hashes[first + i] == compiled.hashes[strings.first[place] + i]
        first, place = first[same], place[same]
    for start, string, at in zip(first.tolist(), place.tolist(), strings.first[place].tolist()):
        if words.bytes_of(start, start + strings.length) == compiled.bytes_of(at, at + strings.length):
            yield start, string


def search(texts: pa.Array, compiled: Compiled) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its words, the runs ``[first, last)`` of hit words, the ids of items that occur."""
    words = words_of(texts, ALPHANUMERIC)
    n_rows = len(texts)
    edges = np.zeros(len(words.hashes) + 1, np.int64)
    met: list[set[int]] = [set() for _ in range(n_rows)]
    for strings in compiled.strings:
        for start, string in _occurrences(words, compiled, strings):
            edges[start] += 1
            edges[start + strings.length] -= 1
            met[int(np.searchsorted(words.offsets, start, "right")) - 1].update(strings.rows[strings.offsets[string] : strings.offsets[string + 1]].tolist())
    items = [{i for row in rows for i in compiled.ids[row]} for rows in met]
    hit = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    hit_first, hit_last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n_rows)]
    for first, last in zip(hit_first.tolist(), hit_last.tolist()):
        row = int(np.searchsorted(words.offsets, first, "right")) - 1
        while first < last:  # a run may go on in the next text
            stop = min(last, int(words.offsets[row + 1]))
            if first < stop:
                runs[row].append((first - int(words.offsets[row]), stop - int(words.offsets[row])))
            first, row = stop, row + 1
    return np.diff(words.offsets).tolist(), runs, [sorted(i) for i in items]


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[tuple[list[tuple[list[str], str]], bool]]:
    """``(item ids, text)`` rows of the benchmark, about ``pass_bytes`` at a time, and whether they are the last.

    Equal texts are one row with all their ids. The driver holds one pass at a time.
    """
    rows = benchmark.where("text is not null").groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    bytes_of_ids = F.aggregate("ids", F.lit(0).cast("bigint"), lambda total, i: total + F.octet_length(i))
    total = rows.agg(F.sum(F.octet_length("text") + bytes_of_ids)).first()[0] or 0
    parts = 1 if total <= pass_bytes else -(-2 * total // pass_bytes)
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else rows
        yield [(r.ids, r.text) for r in mine.collect()], part == parts - 1


def _merged(runs: list[tuple[int, int]], more: list[dict]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted([*runs, *((m["first"], m["last"]) for m in more)]):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``doc_id, n_words, hits, items`` of every row of ``docs``.

    ``hits`` are the runs of words inside occurrences and ``items`` the ids of
    the items that occur. Several passes over a large benchmark add up.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text")
    for items, last in _passes(benchmark, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(compile_strings(items, window))  # bounded by ``pass_bytes``

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    n_words, runs, ids = search(part.column("text"), shared.value)
                    if "hits" in part.schema.names:
                        runs = [_merged(r, m) for r, m in zip(runs, part.column("hits").to_pylist())]
                        ids = [sorted({*i, *m}) for i, m in zip(ids, part.column("items").to_pylist())]
                    hits = pa.array([[{"first": a, "last": b} for a, b in r] for r in runs], _HITS)
                    columns = {"doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "hits": hits, "items": pa.array(ids, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_pydict(columns if last else columns | {"text": part.column("text")})

        schema = f"doc_id {kind}, n_words bigint, hits array<struct<first: bigint, last: bigint>>, items array<string>"
        found = found.mapInArrow(run, schema if last else f"{schema}, text string")
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` without the rows in which a test string occurs; columns unchanged."""
    for items, _ in _passes(benchmark, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(compile_strings(items, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    _, runs, _ = search(part.column("text"), shared.value)
                    yield part.filter(pa.array([not r for r in runs]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, run: total + run["last"] - run["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
with
d as (select doc_id, row_number() over () row_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from documents),
b as (select item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
      from benchmark where text is not null),
s as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') s
      from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
p as (select row_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, (select distinct n from s) where len(w) >= n),
o as (select p.row_id, p.i, p.n, s.item_id from p join s on s.n = p.n and s.s = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
h as (select row_id, count(distinct place) n_hit from (select row_id, unnest(generate_series(i, i + n - 1)) place from o) group by row_id),
k as (select row_id, count(*) n_items, string_agg(item, ',' order by item) ids
      from (select distinct row_id, cast(item_id as varchar) item from o where item_id is not null) group by row_id)
select d.doc_id, cast(coalesce(len(d.w), 0) as bigint) n_words, cast(coalesce(h.n_hit, 0) as bigint) n_hit,
  cast(coalesce(k.n_items, 0) as bigint) n_items, sha256(coalesce(k.ids, '')) items_sha256, coalesce(h.n_hit, 0) > 0 contaminated
from d left join h using (row_id) left join k using (row_id)"""
