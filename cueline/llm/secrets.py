"""Secret scan with a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. From its syntax tree follows a Boolean
trigram query: what every match must contain. The index holds, for each trigram
of any query, the documents (keyed by id and text) that contain it; intersecting
postings gives the candidates of each rule, and only they are matched. A rule
without mandatory trigrams is matched against every text.

Texts and queries are compared in lower case, so a query may admit too much but
never too little. Spans come from one expression over the text: the pieces
between matches and the matches have lengths, and their running sum is the
position of each match in code points.

Defined results: a null text has no spans. Null and repeated ``doc_id`` values
are rows like any other; equal rows share postings. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as syntax
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.tables import read


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least code points of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of hex digits is matched whole or not at all, so the least length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the index adds.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + MORE

#: Literal alternatives of one place that are still told apart.
_MOST = 64
#: Trigrams of one clause; more of them say little more.
_CLAUSE = 4

Clauses = frozenset[frozenset[str]]
_ANY: Clauses = frozenset([frozenset()])


def _trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _all(left: Clauses, right: Clauses) -> Clauses:
    joined = {a | b for a, b in product(left, right)}
    return frozenset(c for c in joined if not any(d < c for d in joined)) if len(joined) <= _MOST else left


def _any(parts: Iterable[Clauses]) -> Clauses:
    joined = frozenset().union(*parts)
    return _ANY if frozenset() in joined or len(joined) > _MOST else joined


def _literals(op, value) -> set[str] | None:
    """The strings of one character that an item matches, in lower case, if few."""
    if op is syntax.LITERAL:
        return {chr(value).lower()}
    if op is syntax.IN and not any(kind in (syntax.NEGATE, syntax.CATEGORY) for kind, _ in value):
        size = sum(1 if kind is syntax.LITERAL else v[1] - v[0] + 1 for kind, v in value)
        if size <= 8:
            return {chr(c).lower() for kind, v in value for c in ([v] if kind is syntax.LITERAL else range(v[0], v[1] + 1))}
    return None


def _query(items) -> Clauses:
    """Clauses of trigrams, one of which any match of the sequence contains whole."""
    found, literals = _ANY, {""}

    def close() -> None:
        nonlocal found, literals
        found = _all(found, _any([frozenset([_trigrams(x)]) for x in literals]))
        literals = {""}

    def extend(choices: set[str]) -> None:
        nonlocal literals
        if len(literals) * len(choices) > _MOST:
            close()
        literals = {a + b for a, b in product(literals, choices)}

    for op, value in items:
        if (single := _literals(op, value)) is not None:
            extend(single)
        elif op is syntax.SUBPATTERN:
            exact = _exact(value[3])
            if exact is not None:
                extend(exact)
            else:
                close()
                found = _all(found, _query(value[3]))
        elif op is syntax.BRANCH:
            exact = _exact([(op, value)])
            if exact is not None:
                extend(exact)
            else:
                close()
                found = _all(found, _any(_query(branch) for branch in value[1]))
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and (exact := _exact([(op, value)])) is not None:
            extend(exact)
        else:
            close()
            if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[0] > 0:
                found = _all(found, _query(value[2]))
    close()
    return found


def _exact(items) -> set[str] | None:
    """All strings that a sequence matches, in lower case, if few."""
    strings = {""}
    for op, value in items:
        if (single := _literals(op, value)) is not None:
            choices: set[str] | None = single
        elif op is syntax.SUBPATTERN:
            choices = _exact(value[3])
        elif op is syntax.BRANCH:
            each = [_exact(branch) for branch in value[1]]
            choices = None if any(e is None for e in each) else set().union(*each)
        elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and value[1] <= 4 and (once := _exact(value[2])) is not None:
            choices = {"".join(p) for n in range(value[0], int(value[1]) + 1) for p in product(once, repeat=n)} if len(once) <= 4 else None
        else:
            choices = None
        if choices is None or len(strings) * len(choices) > _MOST:
            return None
        strings = {a + b for a, b in product(strings, choices)}
    return strings


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams, all of one of which any match contains; ``[[]]``: none is mandatory."""
    clauses = _query(parser.parse(pattern))
    # The first and last trigrams of a long clause are enough to select.
    return sorted(sorted(c) if len(c) <= _CLAUSE else sorted(c)[: _CLAUSE // 2] + sorted(c)[-_CLAUSE // 2 :] for c in clauses)


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings ``(trigram, key)`` of the given trigrams over whole texts."""
    lower = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("lower"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(row_key().alias("key"), lower.alias("lower")).select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key, kinds``: rules one of whose clauses has all its trigrams in the document."""
    clauses = [
        (rule.kind, k, t, 1 << i, (1 << len(c)) - 1)
        for rule in rules for k, c in enumerate(trigram_query(rule.pattern)) for i, t in enumerate(c)
    ]
    table = index.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, bit int, full int")
    # The clauses come from the rules, a list in the program.
    met = index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of a rule's matches, in code points, end exclusive.

    Matches are leftmost and do not overlap; those whose group is too short are
    dropped afterwards, as they still use up their text.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("match"), F.transform(kept, F.length).alias("kept"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def used(x: Column) -> Column:
        return x["gap"] + F.coalesce(x["match"], F.lit(0))

    def step(state: Column, x: Column) -> Column:
        begin, end = state["at"] + x["gap"], state["at"] + used(x)
        span = F.struct(begin.alias("start"), end.alias("end"))
        found = F.when(x["kept"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # To append copies what is there. So the pieces are cut into blocks, about as many as a block has pieces: the
    # places where blocks start come from their sums, and each block lists its own spans from there.
    def cut(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(pieces), width), lambda at: F.slice(pieces, at, width))

    def listed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, x: total + used(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return F.zip_with(
            blocks, F.slice(starts, 1, F.size(blocks)),
            lambda block, at: F.aggregate(block, F.struct(at.alias("at"), nothing.alias("found")), step)["found"],
        )

    return F.flatten(_given(_given(zipped, cut), listed))


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id`` and one column of spans per rule, for every row of ``docs``."""
    indexed = [r for r in rules if [] not in trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for c in trigram_query(r.pattern) for t in c})
    docs = docs.select("doc_id", "text")
    found = candidates(trigram_index(docs, trigrams), indexed)
    keyed = docs.withColumn("key", row_key()).join(found, "key", "left")
    text, empty = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<struct<start:int,end:int>>")

    def column(rule: Rule) -> Column:
        wanted = F.array_contains("kinds", rule.kind) if rule in indexed else text.rlike(rule.pattern)
        return F.when(wanted, spans(text, rule)).otherwise(empty).alias(rule.kind)

    return keyed.select("doc_id", *[column(r) for r in rules])


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _joined(kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of the given kinds by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    texts = F.transform(
        F.array_sort(F.concat(*[_ranked(k, i) for i, k in enumerate(kinds)])),
        lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(texts, ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined([r.kind for r in RULES]).alias("spans"),
    )


def _oracle() -> str:
    def kind(i: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""
  select row_id, '{rule.kind}' kind, {i} rank, {rule.least} least, unnest(generate_series(1, len(string_split_regex(text, '{p}')))) i,
    unnest(string_split_regex(text, '{p}')) gap, unnest(regexp_extract_all(text, '{p}', 0)) m, unnest(regexp_extract_all(text, '{p}', {rule.group})) g
  from d where regexp_matches(text, '{p}')"""

    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in BASE)
    out = ", ".join(f"cast(coalesce(n_{r.kind}, 0) as bigint) n_{r.kind}" for r in BASE)
    return f"""
with
d as (select doc_id, text, row_number() over () row_id from documents),
m as ({" union all ".join(kind(i, r) for i, r in enumerate(RULES))}),
p as (select *, sum(len(gap) + coalesce(len(m), 0)) over (partition by row_id, kind order by i) until from m),
s as (select row_id, kind, rank, until - len(m) first, kind || ':' || cast(until - len(m) as varchar) || ':' || cast(until as varchar) span
      from p where len(g) >= least),
a as (select row_id, {counts}, string_agg(span, ',' order by first, rank) filter (kind in ({base})) base,
        string_agg(span, ',' order by first, rank) spans from s group by row_id)
select doc_id, {out}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (row_id)"""


ORACLE_SQL = _oracle()
