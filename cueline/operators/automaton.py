"""Rule tables of any length: one automaton finds all rules of a text in one pass.

A rule table is read in order, in passes of a bounded number of bytes. A pass is
broadcast, every Python worker builds its automaton once, and each text is walked once
however many rules there are. Detection is a union over passes; ordered replacement
is their sequence, so neither depends on where passes end.

The results are those of the loops in :mod:`cueline.operators.rules`, which suit
short rule lists since they need no Python worker.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.operators.rules import issue, no_issues

PASS_BYTES = 16 << 20
"""Bytes of rules that one pass holds."""

PIECE_BYTES = 1 << 20
"""Bytes of input that a worker turns into Python values at a time."""

KEPT = 4
"""Automata that a worker keeps for its next tasks."""

HITS = T.ArrayType(T.StructType().add("wrong", "string").add("correct", "string"))

_built: dict[str, Any] = {}


class Matcher:
    """An automaton over words; a word stands for all places it has in the list."""

    def __init__(self, words: Iterable[str]):
        places: dict[str, list[int]] = {}
        for place, word in enumerate(words):
            if word:
                places.setdefault(word, []).append(place)
        self.longest = max(map(len, places), default=0)
        self._automaton = ahocorasick.Automaton()
        for word, found in places.items():
            self._automaton.add_word(word, found)
        self._automaton.make_automaton()

    def places(self, text: str) -> set[int]:
        """The places of all words that occur in the text."""
        if not self.longest:
            return set()
        return {place for _, found in self._automaton.iter(text) for place in found}


class RulePass:
    """Rules ``(wrong, correct)`` in order."""

    def __init__(self, pairs: Sequence[tuple[str, str]]):
        self.pairs = pairs
        self.matcher = Matcher(w for w, _ in pairs)

    def hits(self, text: str, unless_corrected: bool) -> list[tuple[str, str]]:
        found = (self.pairs[i] for i in sorted(self.matcher.places(text)))
        return [(w, c) for w, c in found if not (unless_corrected and c in text)]

    def replaced(self, text: str) -> str:
        """All replacements in rule order; later rules see earlier results.

        After a replacement only the places around it can hold a new word.
        """
        waiting = list(self.matcher.places(text))
        heapq.heapify(waiting)
        reach, done = self.matcher.longest - 1, -1
        while waiting:
            rule = heapq.heappop(waiting)
            wrong, correct = self.pairs[rule]
            if rule == done or wrong not in text:
                continue
            done = rule
            parts = text.split(wrong)
            text, at, seen = correct.join(parts), 0, -1
            for part in parts[:-1]:
                at += len(part)
                first, last = max(at - reach, 0), at + len(correct) + reach
                at += len(correct)
                if first <= seen:  # windows that touch are walked as one
                    seen = last
                    continue
                if seen >= 0:
                    self._notice(text[opened:seen], rule, waiting)
                opened, seen = first, last
            self._notice(text[opened:seen], rule, waiting)
        return text

    def _notice(self, window: str, rule: int, waiting: list[int]) -> None:
        for other in self.matcher.places(window):
            if other > rule:
                heapq.heappush(waiting, other)


def _passes(rules: DataFrame | Iterable[tuple[str, str]], order: Sequence[str], pass_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Rules in order, in runs of bounded size; ``wrong`` neither empty nor its own correction."""
    if isinstance(rules, DataFrame):
        usable = rules.where("wrong <> '' and correct is not null and wrong <> correct")
        rules = ((r.wrong, r.correct) for r in usable.orderBy(*order, "wrong").select("wrong", "correct").toLocalIterator())
    run, size = [], 0
    for wrong, correct in rules:
        if wrong and wrong != correct:
            run.append((wrong, correct))
            size += len(wrong) + len(correct) + 64
        if size > pass_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def shared(df: DataFrame, value: Any, build: Callable[[Any], Any]) -> Callable[[], Any]:
    """``build(value)`` on every worker: the value is broadcast, what is built from it is kept."""
    sent, key = df.sparkSession.sparkContext.broadcast(value), uuid.uuid4().hex

    def get() -> Any:
        if key not in _built:
            while len(_built) >= KEPT:
                del _built[next(iter(_built))]
            _built[key] = build(sent.value)
        return _built[key]

    return get


def bounded(batches: Iterator[pa.RecordBatch], columns: Sequence[str], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose ``columns`` hold about ``most`` bytes each, or one row.

    A batch has a fixed number of rows, so its size follows the length of its texts, and
    the Python values made of it are several times as large."""
    for batch in batches:
        at = [(0, batch.num_rows)]
        while at:
            first, n = at.pop()
            piece = batch.slice(first, n)
            if n > 1 and sum(piece.column(c).nbytes for c in columns) > most:
                at += [(first + n // 2, n - n // 2), (first, n // 2)]
            else:
                yield piece


def map_column(df: DataFrame, inputs: Sequence[str], out: str, kind: T.DataType, make: Callable[[], Callable]) -> DataFrame:
    """``df`` with ``out``, computed from the values of ``inputs`` row by row inside pieces of Arrow batches."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out]).add(out, kind)
    arrow = T.StructType().add(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        function, target = make(), to_arrow_schema(arrow).field(0).type
        for batch in bounded(batches, inputs):
            values = [function(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs))]
            kept = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(values, target)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def with_rule_hits(
    df: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], text: str = "text", out: str = "hits",
    order: Sequence[str] = ("category_rank", "rule_order"), unless_corrected: bool = False, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``df`` with the rules whose ``wrong`` occurs in ``text``, as an array in rule order.

    ``unless_corrected`` leaves out rules whose correction occurs as well. A null text has no hits.
    """
    found = df.withColumn(out, F.array().cast(HITS))
    for pairs in _passes(rules, order, pass_bytes):
        get = shared(df, pairs, RulePass)

        def make(get=get):
            rule_pass = get()
            return lambda body, before: before + [{"wrong": w, "correct": c} for w, c in rule_pass.hits(body or "", unless_corrected)]

        found = map_column(found, [text, out], out, HITS, make)
    return found


def with_replacements(
    df: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], text: str = "text", out: str | None = None,
    order: Sequence[str] = ("category_rank", "rule_order"), pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``df`` with ``text`` after all replacements in rule order. Null stays null."""
    out = out or text
    found = df if out == text else df.withColumn(out, F.col(text))
    for pairs in _passes(rules, order, pass_bytes):
        get = shared(df, pairs, RulePass)

        def make(get=get):
            rule_pass = get()
            return lambda body: None if body is None else rule_pass.replaced(body)

        found = map_column(found, [out], out, T.StringType(), make)
    return found


def violations(hits: Column, issue_type: str = "errata_violation") -> Column:
    """Hits as critical issues."""
    return F.transform(hits, lambda h: issue(issue_type, "critical", None, F.concat(h["wrong"], F.lit("→"), h["correct"])))


# -- rules that need a context -------------------------------------------------------

_CONTEXTUAL = T.ArrayType(T.StructType().add("issue_type", "string").add("wrong", "string").add("correct", "string"))


class ContextRules:
    """Domains with keywords that share one rule list, and groups of rules with cues of their own."""

    def __init__(self, spec: tuple):
        literal, domains, groups = spec
        self.rules = RulePass(literal)
        self.names = [name for name, _ in domains]
        self.words, self.domain_of = self._index(words for _, words in domains)
        self.cues, self.group_of = self._index(cues for cues, _ in groups)
        self.fixes = [(g, w, c) for g, (_, fixes) in enumerate(groups) for w, c in fixes]
        self.fix_words = Matcher(w for _, w, _ in self.fixes)

    @staticmethod
    def _index(lists: Iterable[Sequence[str]]) -> tuple[Matcher, list[int]]:
        pairs = [(word, owner) for owner, words in enumerate(lists) for word in words]
        return Matcher(w for w, _ in pairs), [owner for _, owner in pairs]

    def hits(self, body: str, context: str) -> list[dict]:
        if not body:
            return []
        found = []
        domains = sorted({self.domain_of[p] for p in self.words.places(context)})
        if domains and (pairs := self.rules.hits(body, True)):
            found += [{"issue_type": f"contextual_{self.names[d]}_errata", "wrong": w, "correct": c} for d in domains for w, c in pairs]
        if fixes := sorted(self.fix_words.places(body)):
            groups = {self.group_of[p] for p in self.cues.places(context)}
            found += [{"issue_type": "contextual_disambiguation", "wrong": w, "correct": c} for g, w, c in (self.fixes[p] for p in fixes) if g in groups]
        return found


def with_contextual_hits(
    df: DataFrame, literal: Sequence[tuple[str, str]], keywords: Sequence[tuple[str, Sequence[str]]],
    disambiguation: Sequence[tuple[Sequence[str], Sequence[tuple[str, str]]]], body: str = "body", context: str = "context", out: str = "issues",
) -> DataFrame:
    """``df`` with the issues of :func:`cueline.operators.rules.contextual_hits`, for any number of domains and rules.

    Domains and cues are looked up by one walk over the context, rules by one walk over the body.
    """
    spec = [(w, c) for w, c in literal if w and w != c], list(keywords), [(cues, [(w, c) for w, c in fixes if w != c]) for cues, fixes in disambiguation]
    get = shared(df, spec, ContextRules)

    def make():
        rules = get()
        return lambda text, around: rules.hits(text or "", around or "")

    found = map_column(df, [body, context], out, _CONTEXTUAL, make)
    detail = lambda h: F.concat(h["wrong"], F.lit("→"), h["correct"])
    issues = F.transform(out, lambda h: issue(h["issue_type"], "critical", None, detail(h)))
    return found.withColumn(out, F.when(F.size(out) > 0, issues).otherwise(no_issues()))


# -- longest matches ------------------------------------------------------------------


class Trie:
    """Phrases as nested dictionaries; the longest that starts at a place is one walk."""

    _END = ""

    def __init__(self, phrases: Iterable[str]):
        self.root: dict = {}
        for phrase in phrases:
            node = self.root
            for character in phrase:
                node = node.setdefault(character, {})
            if phrase:
                node[self._END] = True

    def cut(self, text: str) -> list[str]:
        """Greedy longest phrases from the left; other characters stand alone."""
        found, at, root, end = [], 0, self.root, self._END
        while at < len(text):
            node, place, last = root.get(text[at]), at + 1, at + 1
            while node is not None:
                if end in node:
                    last = place
                node, place = (node.get(text[place]), place + 1) if place < len(text) else (None, place)
            found.append(text[at:last])
            at = last
        return found


def with_tokens(df: DataFrame, dictionary: DataFrame | Iterable[str], text: str = "text", out: str = "tokens", max_len: int = 6) -> DataFrame:
    """``df`` with the greedy longest-match words of ``text``, for dictionaries of any usual size.

    ``dictionary`` is a list or a table with a column ``word``; words of 2 to ``max_len``
    characters count. A null text has no tokens (null).
    """
    if isinstance(dictionary, DataFrame):
        usable = dictionary.where(F.length("word").between(2, max_len)).select("word").distinct()
        dictionary = (r.word for r in usable.toLocalIterator())
    get = shared(df, sorted({w for w in dictionary if 2 <= len(w) <= max_len}), Trie)

    def make():
        trie = get()
        return lambda body: None if body is None else trie.cut(body)

    return map_column(df, [text], out, T.ArrayType(T.StringType()), make)


def convert_phrases(df: DataFrame, phrases: DataFrame | Sequence[tuple[str, str]], text: str = "text", out: str | None = None) -> DataFrame:
    """``text`` with every longest phrase replaced by its conversion, from the left.

    ``phrases`` holds characters and phrases, ``traditional, simplified``; a phrase goes before its
    characters, so that readings which depend on the word come out right. Null stays null.
    """
    if isinstance(phrases, DataFrame):
        phrases = [(r.traditional, r.simplified) for r in phrases.where("traditional <> '' and simplified is not null").select("traditional", "simplified").toLocalIterator()]
    get = shared(df, dict(phrases), lambda table: (Trie(table), table))

    def make():
        trie, table = get()
        return lambda body: None if body is None else "".join(table.get(piece, piece) for piece in trie.cut(body))

    return map_column(df, [text], out or text, T.StringType(), make)
