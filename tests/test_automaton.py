"""Automata and tries against the loops over rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cueline.operators import automaton as A
from cueline.operators import rules
from cueline.operators.rules import Rules

RULES = [("ab", "b"), ("bb", "a"), ("a", "ca"), ("cc", ""), ("c", "c"), ("", "x"), ("ba", "ab"), ("ab", "d"), ("da", "bbb"), ("aé漢", "漢"), ("漢漢", "字")]


def random_text(pick, n):
    return "".join(pick.choice("abcdé漢") for _ in range(n))


@pytest.mark.parametrize("pass_bytes", [1 << 20, 100])
def test_rules_equal_the_loop(spark, pass_bytes):
    pick = random.Random(3)
    texts = [(i, random_text(pick, pick.randint(0, 40)), "kept") for i in range(300)] + [(300, None, "kept"), (301, "", None)]
    df = spark.createDataFrame(texts, "i int, text string, other string").repartition(3)
    usable = [r for r in RULES if r[0]]
    got = A.with_replacements(A.with_rule_hits(df, RULES, pass_bytes=pass_bytes), RULES, out="fixed", pass_bytes=pass_bytes)
    got = A.with_rule_hits(got, RULES, out="open", unless_corrected=True, pass_bytes=pass_bytes)
    want = df.select("i", rules.apply_literal(F.col("text"), usable).alias("fixed"), rules.literal_hits(F.col("text"), usable).alias("hits"), rules.literal_hits(F.col("text"), usable, unless_corrected=True).alias("open"))
    details = lambda hits: [f"{h.wrong}→{h.correct}" for h in hits]
    expected = {r.i: (r.fixed, [h.detail for h in r.hits], [h.detail for h in r.open]) for r in want.collect()}
    assert {r.i: (r.fixed, details(r.hits), details(r.open)) for r in got.collect()} == expected


def test_replacements_equal_the_loop_for_many_rule_lists():
    pick = random.Random(9)
    for _ in range(2000):
        pairs = [(random_text(pick, pick.randint(1, 3)), random_text(pick, pick.randint(0, 3))) for _ in range(pick.randint(1, 8))]
        pairs = [(w, c) for w, c in pairs if w != c]
        text = want = random_text(pick, pick.randint(0, 30))
        for wrong, correct in pairs:
            want = want.replace(wrong, correct)
        assert A.RulePass(pairs).replaced(text) == want


def test_a_table_of_100_000_rules(spark):
    """One walk per text; a sample of rules gives what the loop gives."""
    table = spark.range(100_000).select(F.lit("custom").alias("category"), F.col("id").alias("rule_order"), F.concat(F.lit("w"), F.col("id"), F.lit("x")).alias("wrong"), F.concat(F.lit("v"), F.col("id")).alias("correct"))
    flat = rules.flatten_rules(table, ["custom"])
    texts = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.col("id") * 977 + k * 131) % 120_000, F.lit("x")))).alias("text"))
    got = A.with_replacements(A.with_rule_hits(texts, flat), flat, out="fixed").collect()
    for r in got:
        numbers = [int(n) for n in re.findall(r"w(\d+)x", r.text)]
        assert sorted(h.wrong for h in r.hits) == sorted({f"w{n}x" for n in numbers if n < 100_000})
        assert r.fixed == re.sub(r"w(\d+)x", lambda m: f"v{m[1]}" if int(m[1]) < 100_000 else m[0], r.text)


def test_time_grows_with_the_text_alone():
    pairs = [(f"w{i}x", f"v{i}") for i in range(50_000)]
    short, long = A.RulePass(pairs), " ".join(f"w{i % 60_000}x" for i in range(20_000))
    start = time.perf_counter()
    short.hits(long[:14_000], False)
    first = time.perf_counter() - start
    start = time.perf_counter()
    short.hits(long, False)
    assert time.perf_counter() - start < 100 * max(first, 1e-3)


def test_context_rules_equal_the_expressions(spark):
    pick = random.Random(5)
    rows = [(i, random_text(pick, pick.randint(0, 12)), random_text(pick, 25)) for i in range(300)] + [(300, "", "abc"), (301, "ab", ""), (302, None, "abc")]
    df = spark.createDataFrame(rows, "i int, body string, context string")
    spec = Rules(literal=(("ab", "c"), ("b", "漢"), ("a", "a")), keywords=(("one", ("cc", "dé")), ("two", ("漢a",))), disambiguation=((("bb",), (("a", "é"), ("cd", "d"))), (("db", "éé"), (("ba", "ab"),))))
    got = A.with_contextual_hits(df, spec.literal, spec.keywords, spec.disambiguation)
    want = df.select("i", rules.contextual_hits(F.col("body"), F.col("context"), spec).alias("issues"))
    pairs = lambda d: {r.i: [(h.issue_type, h.severity, h.value, h.detail) for h in r.issues or []] for r in d.collect()}
    assert pairs(got) == pairs(want)


def test_a_thousand_domains(spark):
    domains = [(f"d{i}", [f"k{i}!", f"m{i}!"]) for i in range(1000)]
    literal = [(f"w{i}x", f"v{i}") for i in range(1000)]
    df = spark.createDataFrame([(1, "w5x w999x", "k7! m7! k999!"), (2, "w5x", "none")], "i int, body string, context string")
    found = {r.i: [(h.issue_type, h.detail) for h in r.issues] for r in A.with_contextual_hits(df, literal, domains, []).collect()}
    assert found == {1: [(f"contextual_d{d}_errata", f"w{w}x→v{w}") for d in (7, 999) for w in (5, 999)], 2: []}


def test_tokens_equal_the_pattern(spark):
    words = ["ab", "abc", "bcda", "漢é", "é漢é漢", "toolongword", "d"]
    pick = random.Random(4)
    df = spark.createDataFrame([(random_text(pick, pick.randint(0, 40)),) for _ in range(200)] + [(None,)], "text string")
    got = A.with_tokens(df.withColumn("want", rules.tokens(F.col("text"), words)), words).collect()
    assert all(r.tokens == r.want for r in got) and len(got) == 201


def test_a_dictionary_of_200_000_words(spark):
    words = spark.range(200_000).select(F.substring(F.concat(F.lit("w"), F.hex("id")), 1, 9).alias("word"))
    df = spark.createDataFrame([("w1F4w1F4Aw0zw30D3F w30D40",)], "text string")
    assert A.with_tokens(df, words, max_len=9).first().tokens == ["w1F4", "w1F4A", "w0", "z", "w30D3F", " ", "w30D4", "0"]


def test_phrases_go_before_characters(spark):
    table = spark.createDataFrame([("乾", "干"), ("隆", "隆"), ("乾隆", "乾隆"), ("髮", "发"), ("頭", "头"), ("發", "发"), ("", "x"), ("頭髮", "头发")], "traditional string, simplified string")
    df = spark.createDataFrame([("乾隆的頭髮乾了發",), (None,), ("",)], "text string")
    assert [r.text for r in A.convert_phrases(df, table).collect()] == ["乾隆的头发干了发", None, ""]


def test_pieces_of_long_texts():
    """A batch of long texts is worked on in bounded pieces that hold all its rows in order."""
    import pyarrow as pa

    batch = pa.record_batch({"i": list(range(101)), "text": ["x" * 20_000] * 50 + [None, "y" * 3_000_000] + ["z"] * 49})
    pieces = list(A.bounded(iter([batch, batch.slice(0, 0)]), ["text"], 1 << 20))
    assert pa.Table.from_batches(pieces).column("i").to_pylist() == list(range(101))
    assert len(pieces) > 3 and all(p.column("text").nbytes <= 1 << 20 or p.num_rows == 1 for p in pieces)
