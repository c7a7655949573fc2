"""Operators that SQL cannot express against brute force or held-out accuracy."""

from __future__ import annotations

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import html, lines, minhash, neighbours, quality
from cueline.llm.tables import read
from cueline.llm.words import shingles_of, slices, words_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read(spark, SF, "documents").select("doc_id", "text").collect()}


def near_copies(spark, n=60, words=120):
    """Texts that differ in one word each, two that differ in many, and a copy."""
    base = [f"w{i}" for i in range(words)]
    rows = [(i, " ".join("X%d" % i if k == 2 * i else w for k, w in enumerate(base))) for i in range(n)]
    rows += [(n, " ".join(base)), (n + 1, " ".join(base)), (n + 2, " ".join(base[: words // 2] + ["y"] * 60)), (n + 3, "w0 w1"), (n + 4, "W0  w1")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)


def plain_links(texts):
    """Links, links between different texts, and the smallest id of each component."""
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    where = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            where[s].append(i)
    shared = collections.Counter((a, b) for ids in where.values() for k, b in enumerate(ids) for a in ids[:k])
    root, links, others = {i: i for i in texts}, collections.Counter(), collections.defaultdict(set)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            if words[a] != words[b]:
                others[a].add(tuple(words[b]))
                others[b].add(tuple(words[a]))
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: (top(i), links[i], len(others[i])) for i in texts}


def test_links_equal_brute_force(spark, texts):
    found = {r.doc_id: (r.class_id, r.n_links, r.n_linked_texts) for r in minhash.link(read(spark, SF, "documents")).collect()}
    assert found == plain_links(texts)


@pytest.mark.parametrize("tile_rows", [1024, 8])
def test_a_large_group_of_near_copies(spark, monkeypatch, tile_rows):
    """In one tile, where products of matrices count the pairs, and in many."""
    monkeypatch.setattr(minhash, "TILE_ROWS", tile_rows)
    docs, given = near_copies(spark)
    found = {r.doc_id: (r.class_id, r.n_links, r.n_linked_texts) for r in minhash.link(docs).collect()}
    assert found == plain_links(given)


def test_bands_have_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.99), (0.6, 0.99), (0.5, 0.95)):
        bands, rows = minhash.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= minhash.HASHES


def test_signatures_estimate_similarity():
    import pyarrow as pa

    base = [f"w{i}" for i in range(400)]
    column = pa.array([" ".join(base), " ".join(base[40:] + [f"z{i}" for i in range(40)])])
    shingles, offsets = shingles_of(words_of(column))
    a, b = (set(shingles[offsets[i] : offsets[i + 1]].tolist()) for i in (0, 1))
    signature = minhash.signatures(shingles, offsets)
    assert abs((signature[0] == signature[1]).mean() - len(a & b) / len(a | b)) < 0.12


def plain_removed(texts):
    all_lines = [(i, k, frozenset(x.lower().split())) for i in sorted(texts) for k, x in enumerate(texts[i].split("\n"))]
    first, where, late = {}, collections.defaultdict(list), set()
    for i, k, s in all_lines:
        if not s or s in first:
            continue
        first[s] = (i, k)
        common = collections.Counter(t for w in s for t in where[w])
        if any(5 * n >= 4 * (len(s) + len(t) - n) for t, n in common.items()):
            late.add(s)
        for w in s:
            where[w].append(s)
    removed = collections.defaultdict(list)
    for i, k, s in all_lines:
        if s and (s in late or first[s] != (i, k)):
            removed[i].append(k)
    return {i: removed[i] for i in texts}


@pytest.mark.parametrize("tile_rows", [2048, 8])
def test_removed_lines_equal_brute_force(spark, texts, tile_rows):
    found = {r.doc_id: r.removed for r in lines.decide(read(spark, SF, "documents"), tile_rows).collect()}
    assert found == plain_removed(texts)


def test_near_lines_in_tiles(spark):
    base = [f"w{i}" for i in range(30)]
    given = {i: " ".join("X%d" % i if k == i % 30 else w for k, w in enumerate(base)) + f"\nonly {i}\n" for i in range(80)}
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.removed for r in lines.decide(docs, 4).collect()} == plain_removed(given)
    kept = {r.doc_id: r.text for r in lines.remove_lines(docs, 4).collect()}
    assert kept[0] == given[0] and kept[79] == "only 79\n"


def test_nearest_neighbours_equal_brute_force(spark):
    vectors = read(spark, SF, "embeddings")
    found = collections.defaultdict(list)
    for r in neighbours.op9_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        hits += len({i for i, _ in found[q]} & set(ids[order]))
        total += 5
        assert np.allclose([s for _, s in found[q]], np.sort(score[[list(ids).index(i) for i, _ in found[q]]])[::-1], atol=1e-12)
    assert total and hits / total >= 0.9


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(3)
    data, query = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    code, f = neighbours.encode(data)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    q = neighbours.rotation(64) @ (query / np.linalg.norm(query))
    estimate = signs @ q / 8 / f
    true = data @ query / np.linalg.norm(data, axis=1) / np.linalg.norm(query)
    assert (np.abs(estimate - true) <= np.sqrt(1 - f * f) / f * neighbours.WIDTH / np.sqrt(63)).mean() > 0.995


def test_quality_agrees_with_held_out_labels(spark):
    """The labels take no part in training."""
    rated = quality.rate(read(spark, SF, "documents")).join(read(spark, SF, "labels"), "doc_id")
    n, same, clean, kept = rated.agg(
        F.count(F.lit(1)), F.count_if(F.col("keep") == (F.col("quality") == 1)), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & F.col("keep"))
    ).first()
    assert same / n > 0.97 and kept / clean > 0.99


def test_labellers_of_different_kinds_are_told_apart():
    """Kinds of poor text that different labellers see are one class, whatever the others say."""
    cast = np.array([[1, 1, 1, 1], [0, 0, 1, 1], [1, 1, 0, 0], [2, 2, 2, 2]])
    model = quality.fit_labels(cast, np.array([900.0, 60.0, 30.0, 10.0]))
    assert (model.posterior(cast) > 0.5).tolist() == [True, False, False, True]


def test_field_on_held_out_pages():
    field, right, total = html.default_field(), 0, 0
    for page, wanted in html.labelled_pages(100, seed=77):
        found, labels = html.labelled_blocks(page, wanted)
        assert sum(labels) == len(wanted)
        if found:
            right += sum(a == b for a, b in zip(html.viterbi(field.scores(found), field.transitions), labels))
            total += len(found)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        scores, moves = rng.standard_normal((n, 2)), rng.standard_normal((2, 2))

        def value(labels):
            return sum(scores[t, y] for t, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max((tuple((k >> t) & 1 for t in range(n)) for k in range(2**n)), key=value)
        assert tuple(html.viterbi(scores, moves)) == best


def test_articles_of_given_pages(spark):
    """Pages of the table hold their article in one element: a plain cut gives the same text."""
    import html as entities
    import re

    for r in html.extract(read(spark, SF, "pages")).join(read(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        cut = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        inner = re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", cut[1]) if cut else ""
        assert r.text == re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", inner))).strip()


def test_words_across_rows_and_pieces(monkeypatch):
    import pyarrow as pa

    from cueline.llm import words as module

    given = ["abc", "def ghi", None, "", " a\tB\n", "é" * 50, "x" * 40 + " y"]
    whole = words_of(pa.array(given))
    assert np.diff(whole.offsets).tolist() == [1, 2, 0, 0, 2, 1, 2]
    monkeypatch.setattr(module, "_PIECE", 16)
    small = words_of(pa.array(given))
    assert (whole.hashes == small.hashes).all()
    batch = pa.RecordBatch.from_arrays([pa.array(given)], names=["text"])
    parts = [p.column(0).to_pylist() for p in slices(batch, "text", 10)]
    assert [t for p in parts for t in p] == given and len(parts) > 3
