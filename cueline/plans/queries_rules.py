"""Queries over rule tables of any length: automata, tries, and all kinds of rules read from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.functions import text as txt
from cueline.operators import automaton, rules, timeline
from cueline.plans import fixtures as X
from cueline.plans import oracle as O
from cueline.plans.queries_text import CONTEXT, CONTEXTUAL, KEY, documents
from cueline.plans.registry import query

WORDS = """
with words as (select distinct unnest(regexp_extract_all(text, '[a-z]{5,7}')) as wrong from benchmark)"""


def benchmark_words(spark, sf, pattern):
    found = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return X.table(spark, sf, "benchmark").select(found.alias("word")).distinct()


def word_rules(spark, sf):
    """A rule per word of the benchmark, ordered by the word."""
    return benchmark_words(spark, sf, "[a-z]{5,7}").select(F.col("word").alias("wrong"), F.upper("word").alias("correct"))


@query("violations_of_table", WORDS + """
select doc_id, wrong || '→' || upper(wrong) as detail from documents join words on contains(text, wrong)""")
def violations_of_table(spark, sf):
    found = automaton.with_rule_hits(documents(spark, sf).select("doc_id", "text"), word_rules(spark, sf), order=["wrong"])
    return found.select("doc_id", F.inline(automaton.violations(F.col("hits")))).select("doc_id", "detail")


@query("corrections_of_table", WORDS + """,
listed as (select list(wrong order by wrong) as all_words from words)
select doc_id, list_reduce(list_prepend(text, all_words), lambda done, word: replace(done, word, upper(word))) as text from documents, listed""")
def corrections_of_table(spark, sf):
    return automaton.with_replacements(documents(spark, sf).select("doc_id", "text"), word_rules(spark, sf), order=["wrong"])


def rule_tables(spark):
    """Every kind of rule as a table, as a user would keep them."""
    words = [(i, domain, word) for i, (domain, word) in enumerate((d, w) for d, words in X.KEYWORDS for w in words)]
    fixes = [(g * 100 + i, g, list(cues), w, c) for g, (cues, pairs) in enumerate(X.DISAMBIGUATION) for i, (w, c) in enumerate(pairs)]
    return dict(
        literal=X.rule_table(spark),
        regex=spark.createDataFrame([(i, *r) for i, r in enumerate(X.REGEX_RULES)] + [(9, "unused", None)], "rule_order int, pattern string, replacement string"),
        semantic=spark.createDataFrame([(i, *r) for i, r in enumerate(X.SEMANTIC_RULES)] + [(9, None, "unused", None)], "rule_order int, pattern string, correction string, description string"),
        keywords=spark.createDataFrame(words, "rule_order int, domain string, word string"),
        disambiguation=spark.createDataFrame(fixes, "rule_order int, rule_no int, cues array<string>, wrong string, correct string"),
    )


_REGEX = O.values("patterns", "pattern, replacement", X.REGEX_RULES)
_SEMANTIC = O.values("semantic", "pattern, correction, description", X.SEMANTIC_RULES)


@query("all_kinds_from_tables", O.with_(O.RULES, _REGEX, _SEMANTIC) + """
select doc_id, 'errata_violation' as issue_type, wrong || '→' || correct as detail from documents join rules on wrong <> correct and contains(text, wrong)
union all
select doc_id, 'asr_phonetic_error', regexp_extract(text, pattern) || '→' || replacement from documents join patterns on regexp_matches(text, pattern)
union all
select doc_id, 'semantic_anomaly', pattern || '→' || correction from documents join semantic on correction is not null and regexp_matches(text, pattern)""")
def all_kinds_from_tables(spark, sf):
    found = rules.rules_from_tables(**rule_tables(spark))
    rows = automaton.with_rule_hits(documents(spark, sf).select("doc_id", "text"), found.literal)
    text = F.col("text")
    issues = F.concat(automaton.violations(F.col("hits")), rules.regex_hits(text, found.regex), rules.semantic_hits(txt.strip(text), found.semantic))
    return rows.select("doc_id", F.inline(issues)).select("doc_id", "issue_type", "detail")


@query("contextual_from_tables", O.with_(O.SEGMENTS, CONTEXT, O.RULES) + CONTEXTUAL)
def contextual_from_tables(spark, sf):
    found = rules.rules_from_tables(**rule_tables(spark))
    rows = timeline.with_context(X.segments(spark, sf), KEY).withColumn("body", txt.strip(F.col("text")))
    rows = automaton.with_contextual_hits(rows.select("transcript_id", "seg_idx", "body", "context"), found.literal, found.keywords, found.disambiguation)
    return rows.select("transcript_id", F.col("seg_idx").alias("entry_index"), F.inline("issues"))


@query("tokens_of_table", """
with dictionary as (
  select '(?s)' || string_agg(word, '|' order by length(word) desc, word) || '|.' as pattern
  from (select distinct unnest(regexp_extract_all(text, '[a-z]{2,6}')) as word from benchmark)),
t as (select unnest(regexp_extract_all(text, pattern)) as token from documents, dictionary)
select token, count(*) as n from t where length(token) > 1 group by token""")
def tokens_of_table(spark, sf):
    rows = automaton.with_tokens(documents(spark, sf).select("text"), benchmark_words(spark, sf, "[a-z]{2,6}"))
    words = rows.select(F.explode("tokens").alias("token"))
    return words.where(F.length("token") > 1).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# A small conversion table for the given (Latin) text; phrases differ from their characters.
PHRASES = (*X.ACCENTS, ("für", "fuer"), ("über", "ueber"), ("ción", "tion"), ("é ", "é "), ("sch", "sh"), ("schw", "shv"))
_PATTERN = "|".join(sorted((a for a, _ in PHRASES), key=len, reverse=True))


@query("converted_phrases", "with " + O.values("phrases", "a, b", PHRASES) + f""",
lookup as (select map(list(a), list(b)) as to_b from phrases)
select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s){_PATTERN}|.'), lambda t: coalesce(to_b[t], t)), '') as text
from documents, lookup""")
def converted_phrases(spark, sf):
    table = spark.createDataFrame(PHRASES, "traditional string, simplified string")
    return automaton.convert_phrases(documents(spark, sf).select("doc_id", "text"), table)
