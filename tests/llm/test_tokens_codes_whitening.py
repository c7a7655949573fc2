"""Token counts, vector codes and whitening against the library, brute force and plain linear algebra."""

from __future__ import annotations

import hashlib
import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import codes, tokens, whitening
from cueline.llm.tables import read

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "Ein langer Text, it's 12345 漢字 " * 60_000  # 2 MB, more than one run
TEXTS = [
    "", " ", "\n\n \t", "a  b   c\n\n\nd", "don't we'll I'M", "x<|endoftext|>y <|endoftext|><|endoftext|> z", "<|endoftext|>",
    "漢字かな交じり文。한국어 텍스트", "😀👩‍👩‍👧 é́", "a\0b", "՘ new ՘letters࢏ 12", "12 345,678.90", "a" * 5000, "word " * 3000 + "  ", LONG,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def plain_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


# ---- tokens ----


def test_counts_are_the_librarys(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (3, TEXTS[3], "x")], "doc_id bigint, text string, N_TOKENS string").repartition(2)
    rows = tokens.count_tokens(docs).collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].N_TOKENS == "x"
    for r in rows:
        n = plain_tokens(library, r.text)
        assert (r.n_bytes, r.n_tokens_, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)


def test_counts_on_the_table(spark, library):
    docs = read(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = tokens.op11_tokens(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: plain_tokens(library, t) for i, t in texts.items()}


def test_any_first_tier_gives_the_same_counts(spark, monkeypatch):
    docs = read(spark, SF, "documents").where("doc_id < 60").select("doc_id", "text")
    expected = sorted(r.n_tokens for r in tokens.count_tokens(docs).collect())
    assert sorted(r.n_tokens for r in tokens.count_tokens(docs, frequent={}).collect()) == expected
    encoder, texts = tokens.Encoder(tokens.default_path()), [r.text or "" for r in docs.collect()]
    monkeypatch.setattr(tokens, "CACHE_SIZE", 100)  # the cache starts anew again and again
    monkeypatch.setattr(tokens, "_LONG", 50)  # every text is cut lazily
    monkeypatch.setattr(tokens, "_RUN", 7)
    assert sorted(tokens.Lengths(encoder, {}).count(texts)) == expected


def test_first_tier_holds_the_heaviest(spark):
    docs = spark.createDataFrame([(f"alpha beta u{i}",) for i in range(300)], "text string").repartition(3)
    found = tokens.frequent_pre_tokens(docs, size=3)
    assert set(found) <= {"alpha", " beta", " u", "1", "2"} and {"alpha", " beta"} <= set(found)


def test_other_tokenizers_are_asked_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([("Hello  World",), (None,), ("a<|endoftext|>b",)], "text string")
    got = sorted((r.text or "", r.n_tokens) for r in tokens.count_tokens(docs, path).collect())
    asked = Tokenizer.from_file(path)
    assert got == sorted((t or "", len(asked.encode(t or "", add_special_tokens=False).ids)) for t in ("Hello  World", None, "a<|endoftext|>b"))


def test_classes_agree_for_all_assigned_characters(library):
    """The pattern cuts as the library does, but for code points that are unassigned here."""
    cut, pattern = library.pre_tokenizer.pre_tokenize_str, tokens.regex.compile(tokens.PRE_TOKEN)
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or 0x3500 < code < 0x9F00 or 0xAD00 < code < 0xD700 or 0x17100 < code < 0x18700 or 0x20100 < code < 0x2A600:
            continue
        text = f"a{c}1{c}!{c} a"
        assert [text[a:b] for _, (a, b) in cut(text)] == pattern.findall(text), hex(code)


def test_no_documents(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- codes ----


def plain_codes(rows, entries=256, rounds=4):
    """Lloyd by brute force: code, error per row (id, vector), and the digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64)
    parts = x.reshape(len(x), 4, -1).transpose(1, 0, 2)
    books = [p[:entries].copy() for p in parts]
    for last in [False] * rounds + [True]:
        distances = [((p[:, None] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books)]
        nearest = [d.argmin(axis=1) for d in distances]
        if not last:
            for p, b, k in zip(parts, books, nearest):
                for e in np.unique(k):
                    b[e] = p[k == e].sum(axis=0) // (k == e).sum()
    code = ["".join(f"{k[i]:02x}" for k in nearest) for i in range(len(x))]
    error = np.sum([d[np.arange(len(x)), k] for d, k in zip(distances, nearest)], axis=0)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(zip([str(r[0]) for r in rows], code, error.tolist())), digest


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string").repartition(3)


@pytest.mark.parametrize("kind", ["spread", "clusters", "huge", "equal"])
def test_codes_are_those_of_brute_force(spark, kind):
    random = np.random.default_rng(5)
    x = random.standard_normal((700, 8))
    if kind == "clusters":
        x = np.round(random.standard_normal((9, 8))[random.integers(0, 9, 700)], 2) + random.integers(-2, 3, (700, 8)) / 1024
    if kind == "huge":
        x *= 50_000  # no double holds the squares exactly
    if kind == "equal":
        x = np.ones((700, 8))
    rows = [(i // 2 if i < 20 else i, v, i % 3 or None, "c") for i, v in enumerate(x.tolist())]
    found = codes.compress(vectors(spark, [*rows, (900, None, 1, "c"), (901, [1.0, None] * 4, 1, "c"), (902, [float("nan")] * 8, 1, "c"), (903, [float("inf")] * 8, None, "c")])).collect()
    expected, digest = plain_codes([(r[0], r[1]) for r in rows])
    assert sorted((str(r.vec_id), r.code, r.error) for r in found) == expected
    assert {r.codebooks_sha256 for r in found} == {digest}
    for label in (None, 1, 2):
        assert {r.label_error for r in found if r.label == label} == {sum(r.error for r in found if r.label == label)}


def test_most_work_is_done_on_whole_nodes_of_clusters():
    random = np.random.default_rng(3)
    centres = random.integers(-9000, 9000, (40, 4))
    points = (centres[random.integers(0, 40, 8000)] + random.integers(-3, 4, (8000, 4))).astype(np.int64)
    tree = codes.build_tree(points, codes.LEAF)
    found = codes.assign(points[tree.order], tree, centres)
    assert len(found.rows) < len(points) / 2
    one = codes.assign(points[tree.order], tree, points[:1])
    assert len(one.rows) == 0 and set(one.nodes.tolist()) <= {0, 1, 2}  # the whole tree, or its halves


def test_many_labels_are_joined_under_salts(spark, monkeypatch):
    monkeypatch.setattr(codes, "LOOKUP_ROWS", 1)
    rows = [(i, [float(i % 7), 1.0, 2.0, float(i)], i % 3 or None, "c") for i in range(40)]
    found = codes.compress(vectors(spark, rows)).collect()
    assert len(found) == 40
    for label in (None, 1, 2):
        assert {r.label_error for r in found if r.label == label} == {sum(r.error for r in found if r.label == label)}


def test_odd_dimensions_and_small_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1, "c"), (1, [1.0, 2.0, 3.0], 1, "c"), (None, [4.0, 5.0, 6.0], None, "c"), (2, [], 2, "c"), (3, [1e30, -1e30, 0.0, 1.0], 3, "c")]
    found = {(r.vec_id, r.label): (r.code, r.error) for r in codes.compress(vectors(spark, rows)).collect()}
    assert found == {(1, 1): ("00000000", 0), (None, None): ("02020200", 0), (2, 2): ("00000000", 0), (3, 3): ("00000000", 0)}
    assert codes.compress(vectors(spark, [(1, None, 1, "c")])).count() == 0


# ---- whitening ----


def check_whitening(rows, found, components=8):
    """Held against a plain eigenvalue solver, up to signs."""
    x = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    by_row = {}
    for r in found:
        by_row.setdefault((str(r.vec_id), r.deviation), {})[r.component] = r.whitened
        assert r.n == n and abs(r.explained / (values[r.component - 1] / np.trace(covariance)) - 1) < 1e-9 and r.identity_error < 1e-9
    assert {k for k in by_row} == {(str(i), int(((n * v.astype(object) - sums.astype(object)) ** 2).sum())) for (i, _), v in zip(rows, x)}
    white = np.array([[by_row[str(i), int(((n * v - sums) ** 2).sum())][c + 1] for c in range(components)] for (i, _), v in zip(rows, x)])
    assert np.abs(white.T @ white / n - np.eye(components)).max() < 1e-9
    directions = centred.T @ white / n  # covariance times direction, over its root
    for c in range(components):
        assert np.allclose(covariance @ directions[:, c], values[c] * directions[:, c], rtol=1e-8, atol=1e-8 * values[0])


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    check_whitening(rows, whitening.op13_whitening(spark, SF).collect())


def test_whitening_of_unequal_scales_and_bad_rows(spark):
    random = np.random.default_rng(8)
    x = random.standard_normal((60, 12)) * 10.0 ** -(np.arange(12) / 4) * 30
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    bad = [(100, None), (101, [None] * 12), (102, [float("nan")] * 12), (103, [float("-inf")] * 12)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + bad], "vec_id bigint, embedding array<double>, n string").repartition(7)
    check_whitening(rows, whitening.whiten(df).collect())


@pytest.mark.parametrize("kind", ["random", "graded", "equal values", "doubled columns", "low rank", "fewer rows", "diagonal"])
def test_solver(kind):
    random = np.random.default_rng(4)
    x = random.standard_normal((20 if kind == "fewer rows" else 300, 30))
    if kind == "graded":
        x = x * 10.0 ** -np.arange(30)
    if kind == "equal values":
        x = np.linalg.qr(x)[0]
    if kind == "doubled columns":
        x = np.repeat(x[:, :15], 2, axis=1)
    if kind == "low rank":
        x = x[:, :3] @ random.standard_normal((3, 30))
    if kind == "diagonal":
        x = np.vstack([np.diag(np.r_[np.full(10, 3.0), np.full(20, 1.0)])] * 2)
    r = whitening.triangle(x)
    a, b, _ = whitening.bidiagonalise(r)
    squares, expected = whitening.dqds(a, b), np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(squares), expected, rtol=1e-9, atol=1e-13 * expected[0])
    found = whitening.solve(r, len(x))
    white = x @ found.directions / np.sqrt(found.variances)
    assert len(found.variances) == (3 if kind == "low rank" else 8)
    assert np.abs(white.T @ white / len(x) - np.eye(white.shape[1])).max() < 1e-10


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix whose least value a dense solver loses."""
    a, b = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(0, 22, 2.0)
    squares = whitening.dqds(a, b)
    assert abs(np.prod(np.sqrt(squares / a**2)) - 1) < 1e-12  # the determinant holds to the last digits


def test_deviation_is_exact_or_null():
    centred, rest = np.array([[1, 2], [2**31, 0], [2**33, 1]]), np.array([1, 0])
    assert whitening.deviations(centred, 1, rest) == [4, (2**31 - 1) ** 2, None]
    assert whitening.deviations(np.array([[3037000499, 0]]), 1, np.array([0, 0])) == [3037000499**2]


def test_whitening_of_nothing_much(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, []), (3, None)], kind)).count() == 0
    mixed = [(i, [float(i), float(i * i)]) for i in range(5)] + [(i, [float(i)]) for i in range(5)]
    rows = whitening.whiten(spark.createDataFrame(mixed, kind).withColumn("n", F.lit(1))).collect()
    assert len(rows) == 5 * 2 + 5 and max(r.identity_error for r in rows) < 1e-9


def test_triangles_are_reduced_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "REDUCE_BYTES", 64)
    rows = [(i, [float(i), float(i * i % 17), float(i % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)
    check_whitening(rows, whitening.whiten(df).collect(), 3)
