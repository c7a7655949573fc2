from pyspark.sql import functions as F

from cueline.operators import rules
from cueline.operators.rules import Rules


def test_flatten_keeps_first_place_and_last_value(spark):
    rows = [("asr_noise", 0, "乙", "丁"), ("authors", 0, "甲", "甲甲"), ("authors", 1, "乙", "丙"), ("unknown", 0, "x", "y")]
    flat = rules.flatten_rules(spark.createDataFrame(rows, "category string, rule_order int, wrong string, correct string"))
    assert rules.inline_rules(flat) == [("甲", "甲甲"), ("乙", "丁")]


def test_literal_rules(value):
    pair = [("博赫斯", "博尔赫斯")]
    assert value(lambda t: rules.apply_literal(t, pair), "博赫斯写了", "博尔赫斯写了") == ["博尔赫斯写了", "博尔赫斯写了"]
    assert value(lambda t: rules.apply_literal(t, []), "测试") == ["测试"]
    chain = [("a", "b"), ("b", "c")] + [(f"x{i}", "y") for i in range(60)]
    assert value(lambda t: rules.apply_literal(t, chain), "a x7") == ["c y"]


def test_fixpoint_is_longest_first(value):
    pairs = [("互联", "网"), ("互联码", "互联网络")]
    assert value(lambda t: rules.apply_to_fixpoint(t, pairs), "互联码") == ["网网络"]
    assert value(lambda t: rules.apply_to_fixpoint(t, [], [("烫化", "谈话")]), "烫化很有趣") == ["谈话很有趣"]
    assert value(lambda t: rules.apply_regex(t, [(r"(\d+)元", r"¥\1")]), "5元") == ["¥5"]


def test_replacement_dialect():
    assert rules.java_replacement(r"\1-$\g<name>") == r"$1-\$${name}"


def test_hits_inline_and_by_join_agree(spark):
    docs = spark.createDataFrame([(1, "abcab"), (2, "xbc"), (3, "")], "id int, text string")
    many = [("ab", "AB"), ("bc", "BC"), ("zz", "Z"), ("same", "same")]
    by_array = docs.select("id", F.inline(rules.literal_hits(F.col("text"), many))).select("id", "detail")
    table = spark.createDataFrame(many, "wrong string, correct string")
    by_join = rules.rule_hits_by_join(docs, table).select("id", F.concat("wrong", F.lit("→"), "correct"))
    long_list = many + [(f"q{i}", "r") for i in range(60)]
    by_loop = docs.select("id", F.inline(rules.literal_hits(F.col("text"), long_list))).select("id", "detail")
    want = {(1, "ab→AB"), (1, "bc→BC"), (2, "bc→BC")}
    assert {tuple(r) for r in by_array.collect()} == want == {tuple(r) for r in by_join.collect()} == {tuple(r) for r in by_loop.collect()}


def test_contextual_hits(spark):
    rows = spark.createDataFrame([("博赫斯", "谈文学 博赫斯"), ("博赫斯", "天气 博赫斯"), ("博赫斯 博尔赫斯", "文学")], "text string, context string")
    given = Rules(literal=(("博赫斯", "博尔赫斯"),), keywords=(("literature", ("文学",)),))
    found = rows.select(F.transform(rules.contextual_hits(F.col("text"), F.col("context"), given), lambda i: i["issue_type"]).alias("k"))
    assert [r.k for r in found.collect()] == [["contextual_literature_errata"], [], []]


def test_tokens(value):
    make = lambda t: F.array_join(rules.tokens(t, ["分岔", "分岔的花园", "花园"]), "|")
    assert value(make, "小径分岔的花园", "分岔") == ["小|径|分岔的花园", "分岔"]


def test_any_number_of_rules(spark):
    many = [(f"w{i:05d}", f"c{i}") for i in range(2_500)]
    assert spark.range(1).select(rules.apply_literal(F.lit("w02001 w02499 w00000"), many)).first()[0] == "c2001 c2499 c0"
    found = spark.range(1).select(rules.literal_hits(F.lit("w02001"), many).alias("hits")).first().hits
    assert [h.detail for h in found] == ["w02001→c2001"]
    table = spark.createDataFrame([("authors", i, w, c) for i, (w, c) in enumerate(many)], "category string, rule_order int, wrong string, correct string")
    assert rules.inline_rules(rules.flatten_rules(table)) == many
