"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueline.llm import chat, decontamination, html, lines, minhash, mixing, neighbours, quality, secrets, sharding

LONG = " ".join(f"word{i % 977}x{i % 89}" for i in range(60_000)) + " token = abcdef0123456789abcdef0123456789"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1),
    (2, "one two three four five six seven", "en", None, 1),
    (2, "one two three four five six seven", "en", None, 1),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 0),
    (None, "text without an id", "en", "b", 3),
    (6, LONG, "en", "a", len(LONG)),
    (7, "é ß 漢字 😀 password=abc123", "en", "ü", 3),
    (8, "short", "en", "a", 1),
]
ITEMS = [(10, "FOUR five, six"), (11, None), (12, ""), (None, "漢字"), (13, "word0x0 word1x1")]


def clashing(docs):
    """Extra columns with the names that operators use inside."""
    for name in ("size", "place", "digest", "key", "shard", "slot", "lines", "kept_id", "mix_copy", "mix_source", "line_place", "score", "hits", "root", "d", "p", "s", "unit", "Text_"):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def keyed(rows):
    return sorted((tuple("" if v is None else v for v in r) for r in rows), key=str)


def test_sharding(docs, nothing):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(ROWS)
    by_text = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    assert {r.text_crc32 for r in rows if r.doc_id == 6} == {zlib.crc32(LONG.encode())}
    assert sharding.shard(nothing).count() == 0


def test_slots_of_many_blocks(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard(docs, shards=4, parts=2, bundles=8, block_rows=10).collect()
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == 1


def test_schedule_is_longest_first():
    assert sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (3, 4, 5)} == {0}
    taken = mixing.apply_mix(docs)
    assert taken.columns == docs.columns
    assert sum(r.taken for r in rows) == taken.select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert mixing.mix(nothing).count() == 0 and mixing.apply_mix(nothing).count() == 0


def test_secrets(docs, nothing):
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert [tuple(s) for s in found[7]["assign"]] == [(9, 24)]
    begin = LONG.index("token =")
    assert [tuple(s) for s in found[6]["assign"]] == [(begin, len(LONG))]
    assert [tuple(s) for s in found[6]["hex"]] == [(begin + 8, len(LONG))]
    assert found[3]["assign"] == []
    assert secrets.scan(nothing).count() == 0


@pytest.mark.parametrize("text, expected", [
    ("secret=token: abcdefgh", []),  # the first match is too short and uses up its text
    ("SeCrEt  = 'abcdef' x token:zz api-key:123456 api_key:123456", [(0, 17), (45, 59)]),
    ("token=token=abcdef", [(0, 18)]),
])
def test_assignments(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [tuple(s) for s in secrets.scan(docs).first()["assign"]] == expected


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == [[]]
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("ab(cd|ef)?g") == [["abc", "bcd", "cdg"], ["abe", "bef", "efg"], ["abg"]]
    assert secrets.trigram_query("(abc)*x") == [[]]


def test_decontamination(docs, nothing, benchmark):
    rows = {r.doc_id: r for r in decontamination.scan(docs, benchmark).collect()}
    assert [tuple(h) for h in rows[1].hits] == [(3, 6)] and rows[1]["items"] == ["10"]
    assert [tuple(h) for h in rows[7].hits] == [(2, 3)] and rows[7]["items"] == []
    assert rows[6]["items"] == ["13"] and rows[3].n_words == 0
    left = decontamination.remove_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, None, 8}
    assert decontamination.remove_contaminated(docs, benchmark.limit(0)).count() == len(ROWS)
    assert decontamination.scan(nothing, benchmark).count() == 0
    several = decontamination.scan(docs, benchmark, pass_bytes=8).collect()
    assert keyed(several) == keyed(decontamination.scan(docs, benchmark).collect())


def test_minhash(docs, nothing):
    rows = keyed(minhash.link(docs).collect())
    assert len(rows) == len(ROWS)
    assert [r for r in rows if r[0] in (1, 2)] == [(1, 1, 2, 0), (2, 1, 2, 0), (2, 1, 2, 0)]
    assert all(r[2] == 0 for r in rows if r[0] not in (1, 2))
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "6", "7", "8"])
    assert minhash.link(nothing).count() == 0 and minhash.deduplicate(nothing).count() == 0


def worded(name, changed=None):
    """Sixty words; with one of them changed, a near copy."""
    return " ".join("other" if i == changed else f"{name}{i}" for i in range(60))


def kept_texts(spark, rows):
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)


def test_rows_without_ids_are_deduplicated(spark):
    a, b, c = worded("a"), worded("b"), worded("c")
    rows = [(None, a), (None, a), (None, worded("a", 3)), (9, worded("a", 59)), (None, b), (None, b), (None, worded("b", 0)), (None, c), (None, None), (None, None), (None, " ")]
    kept = kept_texts(spark, rows)
    assert [r for r in kept if r[1] and "a5" in r[1]] == [(9, worded("a", 59))]
    assert len([r for r in kept if r[1] and "b5" in r[1]]) == 1
    assert [r for r in kept if not r[1] or "a5" not in r[1] and "b5" not in r[1]] == sorted([(None, c), (None, None), (None, " ")], key=str)


def test_texts_under_one_id_are_deduplicated(spark):
    rows = [(1, worded("a")), (2, worded("a", 3)), (2, worded("b")), (5, worded("c")), (5, worded("c", 0))]
    kept = kept_texts(spark, rows)
    assert kept[:2] == [(1, worded("a")), (2, worded("b"))] and len(kept) == 3 and kept[2] in rows[3:]


def test_names_of_classes_that_share_an_id(spark):
    rows = [(1, worded("a")), (1, worded("b")), (2, worded("b", 0)), (None, worded("c")), (None, worded("c", 0)), (None, worded("d")), (4, None), (None, None), (None, "")]
    found = minhash.link_keyed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    keys = sorted((str(r.class_id), n) for (r, n) in ((r, sum(r.class_key == o.class_key for o in found)) for r in found))
    assert keys == sorted([("1", 1), ("1", 2), ("1", 2), ("None", 2), ("None", 2), ("None", 1), ("4", 1), ("None", 1), ("None", 1)])


def test_lines(docs, nothing):
    rows = {r.doc_id: r for r in lines.decide(docs).collect()}
    assert rows[2].removed == [0] and rows[1].removed == [] and rows[5].removed == []
    assert rows[3].n_lines == 0 and rows[4].n_lines == 1 and rows[5].n_lines == 2
    left = lines.remove_lines(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    assert {r.text for r in left.collect() if r.doc_id == 2} == {""}
    assert lines.decide(nothing).count() == 0 and lines.remove_lines(nothing).count() == 0


@pytest.mark.parametrize("ranked", [False, True])
def test_a_text_of_more_lines_than_an_index_of_22_bits(ranked):
    counts = np.arange(lines.COUNT_BUCKETS, dtype=np.uint64) % np.uint64(300) if ranked else None
    first, last = "one two three four five six", "seven eight nine ten eleven twelve"
    short = lines._Sets(pa.array([f"{first}\n{last}"]), counts)
    long = lines._Sets(pa.array([first + "\n" * (1 << 22) + last]), counts)
    assert len(long.rows) == (1 << 22) + 1 and long.sizes[[0, -1]].tolist() == [6, 6] and long.sizes.sum() == 12
    assert long.words.tolist() == short.words.tolist()
    assert long.digests()[[0, -1]].tolist() == short.digests().tolist()


def test_quality(docs, nothing):
    rows = quality.rate(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.keep and r.score == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert quality.reject_poor(docs).columns == docs.columns
    assert quality.rate(nothing).count() == 0 and quality.reject_poor(nothing).count() == 0


def test_chat(spark):
    turns = [(1, 1, "assistant", "b<s>\\"), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "a\nb", LONG), (2, 0, "assistant", "é"), (2, 0, "assistant", "é")]
    rows = clashing(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(2))
    formatted = chat.format_conversations(rows)
    read = {r.conv_id: chat.parse(r.formatted) for r in formatted.collect()}
    assert read == {1: [("", "x"), ("user", ""), ("assistant", "b<s>\\")], None: [("a\nb", LONG)], 2: [("assistant", "é")] * 2}
    sums = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert sums[2].n_turns == 2 and sums[2].loss_chars == 2 and sums[1].loss_chars == 5
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0


def test_chat_parts(spark, monkeypatch):
    """A conversation longer than a part is written in parts and digested as one."""
    from cueline.llm import chat as module

    turns = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} " + "y" * 50) for c in range(3) for t in range(40)]
    table = [r for r in turns]
    monkeypatch.setattr(module, "PART_BYTES", 300)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in table])
    parts = list(module._format_partition(iter([batch.slice(0, 50), batch.slice(50)])))
    out = pa.Table.from_batches(parts).to_pylist()
    assert max(r["part"] for r in out) > 0
    for c in range(3):
        mine = [r for r in out if r["conv_id"] == c]
        assert [r["part"] for r in mine] == list(range(len(mine)))
        assert [t for r in mine for t in module.parse(r["formatted"])] == [(r[2], r[3]) for r in table if r[0] == c]


def test_neighbours(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 40)]
    bad = [(50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 1.0]), (54, [float("nan"), 1.0, 1.0]), (55, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (56, [1.0, 1.0])]
    vectors = clashing(spark.createDataFrame(good + bad + good[:3], "vec_id bigint, embedding array<float>").repartition(3))
    index = neighbours.build_index(vectors)
    found = neighbours.search(index, vectors.where("vec_id in (1, 50, 53, 56)")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in found} == {1}
    assert [r.vec_id for r in found] == [22, 2, 23, 8, 16] and [r.rank for r in found] == [1, 2, 3, 4, 5]
    assert abs(found[0].score - 1) < 1e-12
    assert neighbours.search(index, vectors.limit(0)).count() == 0
    few = neighbours.search(neighbours.build_index(vectors.where("vec_id in (1, 2)")), vectors.where("vec_id = 1"))
    assert [r.vec_id for r in few.collect()] == [2]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>One&nbsp;two\n three.<script>x='</p>'</script></p><p>Last &lt;b&gt; one.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<div><!-- only markup --></div>"), (5, "u", page[: page.index(" one.</p>")]), (1, "u", page), (None, "u", page)]
    pages = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = {(r.page_id, r.url): r for r in html.extract(pages).collect()}
    assert found[1, "u"].text == "A & B One two three. Last <b> one." and found[1, "u"].n_chars == 34
    assert found[2, None].text == "" and found[3, "u"].text == "" and found[4, "u"].text == ""
    assert found[5, "u"].text == "A & B One two three. Last <b>"
    assert html.extract(pages.limit(0)).count() == 0


def block_texts(page):
    return [b.text for b in html.blocks(page)]


@pytest.mark.parametrize("icon", ["<svg/>", "<svg width=1 />", '<math display="block"/>', "<SVG/>"])
def test_self_closed_drawings_have_no_contents(icon):
    assert block_texts(f"<p>{icon}First.</p><p>Second.</p>") == ["First.", "Second."]
    assert block_texts(f"<p>{icon}First.</p><svg><text>drawn</text></svg><p>Second.</p>") == ["First.", "Second."]


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>T</title><meta name=a><script>'</head><body><p>'</script><style>p {}</style>",
        "<head><!-- </head> --><link rel=x><base href=/><noscript><p>none</p></noscript><template><p>none</p></template>",
        "<head>",
    ],
)
def test_a_head_without_an_end(head):
    assert block_texts(f"<html>{head}<p>First.</p><p>Second.</p>") == ["First.", "Second."]
    assert block_texts(f"<html>{head}First.<p>Second.") == ["First.", "Second."]
    assert block_texts(f"<html>{head}<body><p>First.</p>") == block_texts(f"<html>{head}</head><p>First.</p>") == ["First."]
    assert block_texts(head) == []


@pytest.mark.parametrize(
    "page",
    [
        "<p data-by=O'Brien>First.</p><p>It is Anna's house.</p>",
        "<p title='a > b' data-by = \"c > d\">First.</p><p \">It is Anna's house.</p>",
        "<a href=/?q=\"x>First.</a><p>It is Anna's house.</p>",
    ],
)
def test_quotes_open_a_value_only_after_an_equals_sign(page):
    assert block_texts(page) == ["First.", "It is Anna's house."]


def test_a_quote_without_an_end_is_no_text():
    assert block_texts("<p data-by=O'Brien>First.</p><p>Second.</p>") == ["First.", "Second."]
    assert block_texts("<p>First.</p><p class=\"a>Second.</p>") == ["First.", "Second."]
    assert block_texts("<p>First.</p><a href=\"http://x") == ["First."]


def test_stages_return_the_columns_of_documents(spark, docs, tmp_path, benchmark):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_a_query_with_unusable_repeats_is_kept(spark):
    rows = [(50, v) for v in ([0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("-inf"), 1.0, 1.0], None, [], [None, 1.0, 1.0], [1.0, 2.0, 3.0])]
    rows += [(51, [1.0, 2.0, 3.1]), (100, [0.0, 0.0]), (150, [-1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    found = neighbours.search(neighbours.build_index(vectors), vectors.where("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(50, 1, 51)]


def test_deep_pages_take_linear_time():
    """Ten times the depth in under fifteen times the time (and a little for the clock)."""
    import time

    def seconds(n):
        start = time.perf_counter()
        assert len(html.blocks("<div class=a>x." * n + "</div>" * n)) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 15 * seconds(4_000) + 0.3


#: Boilerplate that was once let through or may be; the training pages were widened with these in view, so they are no held-out figure.
INSIDE = {
    "newsletter": "<div class=newsletter><p>Get our best stories in your inbox every week of the year.</p></div>",
    "comments": "<ol class=comment-list><li class=comment><p>I was there too and it was not at all like that.</p></li></ol>",
    "articles of comments": "<div class=reader-comments><article class=comment><p>I was there too and it was not like that.</p></article></div>",
    "footer": "<footer><p>Published by the river press in the north of the country.</p></footer>",
    "aside": "<aside><p>Read more about the river and its banks in our guide.</p></aside>",
    "menu": "<nav><a href=a>Home</a> <a href=b>News</a></nav>",
    "advert": "<div class=advertisement><p>Buy the new boots for wet weather today.</p></div>",
    "cookies": "<section id=cookie-banner><p>We use cookies to make this page better for you.</p></section>",
    "form": "<form><p>Sign up for more.</p><input name=q></form>",
    "related": "<section class=related-articles><h3>Related</h3><ul><li><a href=x>Old floods</a></li></ul></section>",
    "dialog": "<dialog class=signup-modal><p>Join our readers and get every story first.</p></dialog>",
}


@pytest.mark.parametrize("place", [0, 2, 4])
@pytest.mark.parametrize("kind", INSIDE)
def test_boilerplate_inside_an_article_is_left_out(kind, place):
    said = "The river rose again that night and the village waited for the morning light to come."
    parts = [f"<p>{said}</p>"] * 4
    parts.insert(place, INSIDE[kind])
    page = f"<html><body><nav><a href=/>x</a></nav><article><h1>The river</h1>{''.join(parts)}</article><footer>c</footer></body></html>"
    assert html.main_text(page, html.default_field()) == " ".join(["The river", *[said] * 4])


def test_benchmark_of_megabytes_is_compiled_within_a_small_multiple_of_its_bytes():
    import pickle

    words = [f"w{i}" for i in range(30_000)]
    items = [([str(i)], " ".join(words[(i * 7919 + k * k) % 30_000] for k in range(150))) for i in range(1_500)]
    compiled = decontamination.compile_strings(items)
    assert len(pickle.dumps(compiled)) < 12 * sum(len(text) for _, text in items)
    texts = ["x y " + " ".join(items[7][1].split()[20:30]) + " z", " ".join(items[9][1].split()[:9]), None]
    n_words, runs, ids = decontamination.search(pa.array(texts), compiled)
    assert n_words == [13, 9, 0] and runs == [[(2, 12)], [], []] and "7" in ids[0] and ids[1:] == [[], []]


def test_equal_benchmark_texts_are_one_row_with_all_ids(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    bench = spark.createDataFrame([(f"b{i}", passage) for i in range(50)] + [("c", "alpha beta"), (None, "gamma")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {passage.upper()} then"), (2, "alpha beta gamma"), (3, "clean")], "doc_id long, text string")
    for pass_bytes in (1 << 20, 40):
        rows = {r.doc_id: r for r in decontamination.scan(docs, bench, pass_bytes=pass_bytes).collect()}
        assert sorted(rows[1]["items"]) == sorted(f"b{i}" for i in range(50)) and [tuple(h) for h in rows[1].hits] == [(1, 13)]
        assert rows[2]["items"] == ["c"] and [tuple(h) for h in rows[2].hits] == [(0, 3)]
        assert rows[3]["items"] == [] and rows[3].hits == []


def test_texts_of_many_secrets_or_removed_lines_take_linear_time(spark):
    import time

    many = spark.createDataFrame([(1, "token=abcdef12 " * 30_000), (2, "token=abc secret:abcdef")], "doc_id long, text string")
    began = time.monotonic()
    rows = {r.doc_id: r.assign for r in secrets.scan(many).select("doc_id", "assign").collect()}
    assert [tuple(s) for s in rows[1]] == [(15 * i, 15 * i + 14) for i in range(30_000)] and [tuple(s) for s in rows[2]] == [(10, 23)]
    repeated = spark.createDataFrame([(1, "the same line\n" * 80_000 + "last one here"), (2, "other\nthe same line"), (3, None)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.remove_lines(repeated).collect()}
    assert left[1].split("\n") == ["the same line", "last one here"] and left[2] == "other" and left[3] is None
    assert time.monotonic() - began < 90


def test_lines_of_the_same_words_in_other_numbers_are_removed(spark):
    given = [(1, "a b c d\nb a a c d\nd c b a"), (2, "a a a\na"), (3, "a b c d d d")]
    found = {r.doc_id: r.removed for r in lines.decide(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert found == {1: [1, 2], 2: [1], 3: [0]}


def test_a_row_that_repeats_does_not_fill_the_sample(spark):
    rows = [(1, "one and the same text.")] * 400 + [(i, f"text number {i} of the others.") for i in range(2, 40)]
    sample = quality._sample(spark.createDataFrame(rows, "doc_id long, text string"), len(rows), 1_000)
    assert sample.num_rows == 39 and len(set(sample.column("place").to_pylist())) == 39


def test_the_sample_holds_only_what_documents_have(spark):
    import tracemalloc

    texts = [f"Document {i} says so, and {'again ' * (i % 7)}ends." for i in range(600)] + [LONG[:50_000]]
    sample = quality._sample(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), len(texts), 1_000)
    assert sample.num_rows == len(texts) and sample.nbytes < sample.num_rows * quality.WIDTH  # a float for every feature takes four times that
    tracemalloc.start()
    design, scale = quality._design(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * design.nbytes
    # The same matrix from all features of every row.
    words, row_bytes = quality._parsed(pa.array(texts))
    features, offsets = quality.hashed(words, row_bytes)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    dense = np.zeros((len(texts), quality.WIDTH))
    np.add.at(dense, (rows, features), 1)
    dense = (dense / (np.diff(offsets) + quality.SMOOTHING)[:, None]).astype(np.float32)
    assert np.allclose(scale, 1 / (dense.std(axis=0) + 1e-3), rtol=1e-4)
    plain = np.column_stack([dense * scale, quality._squashed(quality.shares(words, row_bytes)), np.ones(len(texts))]).astype(np.float32)
    assert np.array_equal(sorted(plain.tolist()), sorted(design.tolist()))


def test_lines_are_counted_without_splitting_texts(spark):
    given = [(1, None), (2, ""), (3, "\n"), (4, "a\n\nb\n"), (5, "é\n漢\r\n😀"), (6, "no end")]
    found = lines.decide(spark.createDataFrame(given, "doc_id long, text string"))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.n_lines for r in found.collect()} == {i: 0 if t is None else t.count("\n") + 1 for i, t in given}


def test_words_of_every_length_have_hashes_of_their_own():
    from cueline.llm.words import words_of

    given = ["\0" * n for n in range(1, 70)] + ["ab"[n % 2] + "x" * n for n in range(70)] + ["x" * n + "yz"[n % 2] for n in range(70)]
    one = words_of(pa.array([" ".join(given)])).hashes
    assert len(set(one.tolist())) == len(set(given))
    assert (one == words_of(pa.array(given)).hashes).all() and (one == words_of(pa.array([t.upper() for t in given])).hashes).all()
