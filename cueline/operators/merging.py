"""Merging, splitting and retiming of segments: sequential recurrences.

Each step is a small streaming object: it takes one segment at a time, keeps
the few it may still change, and releases finished ones. The steps are chained
and run by :func:`cueline.operators.ordered.ordered_fold`, so a long transcript
is processed in many blocks at once.
"""

from __future__ import annotations

import copy
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueline.functions.text import char_class, counted, ends_sentence, speed, strip
from cueline.operators.ordered import BLOCK_ROWS, Fold, dense_position, ordered_fold, over_neighbours
from cueline.operators.timeline import finish_timing
from cueline.params import SubtitleParams

MAX_JOIN_GAP_MS = 2000


class Seg(NamedTuple):
    """A stretch of text; ``rows`` are the positions it was made of and
    ``chars`` its counted characters, which add up when segments are joined."""

    start: int
    end: int
    text: str
    rows: tuple[int, ...]
    chars: int

    @property
    def length(self) -> int:
        return self.end - self.start

    def joined(self, other: "Seg") -> "Seg":
        return Seg(self.start, other.end, self.text + other.text, self.rows + other.rows, self.chars + other.chars)


class Limits:
    """Character counts and speed tests of one parameter set.

    ``over`` is set as soon as something was too long for ``max_ms``: until then, a larger limit would have given the same."""

    over = False

    def __init__(self, params: SubtitleParams):
        self.params = params
        # a class stands for one character, so the lengths of its runs add up to the number of matches
        self._counted = re.compile(f"(?:{params.count_class})+")
        self.ends = frozenset(params.sentence_end)
        self.split_at = re.compile(char_class(params.split_marks))
        self.max_ms = params.max_display_s * 1000
        self.min_ms = params.min_display_s * 1000
        self.shortest, self.gap = params.min_display_ms, params.min_gap_ms
        self.capacity, self.max_speed = params.capacity, params.max_speed

    def count(self, text: str) -> int:
        return sum(map(len, self._counted.findall(text)))

    def seg(self, start: int, end: int, text: str, rows: tuple[int, ...]) -> Seg:
        return Seg(start, end, text, rows, self.count(text))

    def closes_sentence(self, text: str) -> bool:
        return text.strip()[-1:] in self.ends

    def closing(self, bodies: Sequence[str]) -> list[bool | None]:
        """Whether each stripped text ends a sentence; None for a blank one, which leaves that as it was."""
        return [body[-1] in self.ends if body else None for body in bodies]

    def rate(self, chars: int, length_ms: int) -> float:
        return chars / (length_ms / 1000) if length_ms > 0 else 0

    def short_enough(self, length_ms: int) -> bool:
        if length_ms <= self.max_ms:
            return True
        self.over = True
        return False

    def pair_fits(self, a: Seg, b: Seg) -> bool:
        """Joined, the two stay within characters, time on screen and speed."""
        chars, length = a.chars + b.chars, b.end - a.start
        return (
            chars <= self.capacity
            and self.short_enough(length)
            and self.rate(chars, length) <= self.max_speed
        )


class Rows:
    """Consecutive rows as columns, prepared once for all settings that count the same characters."""

    def __init__(self, columns: Mapping[str, list], pos: str, first: int, stop: int, limits: Limits):
        self.start, self.end, self.text, self.place = (columns[c][first:stop] for c in ("start_ms", "end_ms", "text", pos))
        self.body = [text.strip() for text in self.text]
        self.chars = [limits.count(text) for text in self.text]
        self.sums = list(accumulate(self.chars, initial=0))
        n = len(self.start)
        self.pauses = [i for i in range(1, n) if self.start[i] - self.end[i - 1] > MAX_JOIN_GAP_MS] + [n]
        """Rows that follow a pause too long to join, and the end."""
        self._made: dict[tuple, list] = {}

    def _once(self, key: tuple, make: Callable[[], list]) -> list:
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def closing(self, limits: Limits) -> list[bool | None]:
        return self._once(("closing", limits.ends), lambda: limits.closing(self.body))

    def closers(self, limits: Limits) -> list[int]:
        """Rows that end a sentence, and the end."""
        return self._once(("closers", limits.ends), lambda: [i for i, shut in enumerate(self.closing(limits)) if shut] + [len(self.start)])

    def haste(self, limits: Limits) -> list[float]:
        """Characters up to a row less those readable until its end: rows from i on are slow enough up to
        row j where this does not exceed the same figure of the start of i."""
        per_ms, origin = limits.max_speed / 1000, self.start[0]
        return self._once(("haste", per_ms), lambda: [n - per_ms * (end - origin) for n, end in zip(self.sums[1:], self.end)])

    def segments(self) -> Iterator[Seg]:
        return (Seg(start, end, text, (at,), n) for start, end, text, at, n in zip(self.start, self.end, self.text, self.place, self.chars))


class Step:
    """One stage of a chain. ``held`` lists the segments not yet released."""

    limits: Limits | None = None

    def under(self, limits: Limits) -> "Step":
        """A copy in the same state that goes on under other limits."""
        twin = object.__new__(type(self))
        twin.__dict__ = {k: v[:] if type(v) is list else v for k, v in self.__dict__.items()}
        twin.limits = limits
        return twin

    def swap(self, seg: Seg, floor: float) -> Seg | None:
        """As ``push`` where one segment comes in and one goes out, both as they are. None, and nothing
        is changed, where there is more to do. No later segment starts before ``floor``."""
        return None

    def push(self, seg: Seg) -> list[Seg]:
        raise NotImplementedError

    def flush(self) -> list[Seg]:
        return []

    @property
    def held(self) -> tuple:
        return ()

    @property
    def earliest(self) -> float:
        """The first start among the segments held."""
        return min((s.start for s in self.held), default=math.inf)


class JoinShort(Step):
    """Join a segment to the running one while the result stays readable.

    The running one is closed when it ends a sentence and can stand alone, or
    when the next does not fit. Text and count of the running one are carried.
    """

    def __init__(self, limits: Limits):
        self.limits, self.rows = limits, []

    def push(self, seg):
        start, end, text, rows, chars = seg
        lim, text = self.limits, text.strip()
        if self.rows:
            span, total = end - self.start, self.chars + chars
            fits = (
                total <= lim.capacity
                and start - self.end <= MAX_JOIN_GAP_MS
                and lim.short_enough(span)
                and lim.rate(total, span) <= lim.max_speed
            )
            if fits and not self._complete():
                self.end, self.chars = end, total
                self.parts.append(text)
                self.rows += rows
                return []
        released = self.flush()
        self.start, self.end, self.chars, self.parts, self.rows = start, end, chars, [text], [*rows]
        return released

    def push_rows(self, rows: Rows) -> Iterator[Seg]:
        """Push rows one after another; what is released comes at once, when ``start`` is that of the row pushed.

        Where characters or a pause end a segment and everything before surely fits, its rows are joined in one go."""
        lim, n = self.limits, len(rows.start)
        starts, ends, counts, bodies, places, sums = rows.start, rows.end, rows.chars, rows.body, rows.place, rows.sums
        capacity, max_ms, min_ms, fastest = lim.capacity, lim.max_ms, lim.min_ms, lim.max_speed
        shuts, closers, haste, per_ms, origin = rows.closing(lim), rows.closers(lim), rows.haste(lim), fastest / 1000, starts[0]
        since = at = 0  # rows of the running segment from ``since`` on are not in ``parts`` and ``held`` yet
        fresh, parts, held = not self.rows, [], []
        if fresh:
            start, end, chars, closes, at = starts[0], ends[0], counts[0], bool(shuts[0]), 1
        else:
            start, end, chars, parts, held = self.start, self.end, self.chars, self.parts, self.rows
            closes = lim.closes_sentence("".join(parts))
        while True:
            whole = False
            if fresh:
                stop = bisect_right(sums, sums[since] + capacity, since + 1) - 1
                stop = max(min(stop, rows.pauses[bisect_right(rows.pauses, since)]), since + 1)
                whole = stop == since + 1 or (
                    closers[bisect_left(closers, since)] >= stop - 1
                    and max(ends[since + 1 : stop]) - start <= max_ms
                    and max(haste[since + 1 : stop]) <= sums[since] - per_ms * (start - origin) - 1e-3
                )
            if whole:
                end, chars, at = ends[stop - 1], sums[stop] - sums[since], stop
            else:
                for at in range(at, n):
                    begin, upto, total = starts[at], ends[at], chars + counts[at]
                    span = upto - start
                    if (
                        total <= capacity
                        and begin - end <= MAX_JOIN_GAP_MS
                        and span <= max_ms
                        and (total / (span / 1000) if span > 0 else 0) <= fastest
                        and not (
                            closes
                            and chars >= 4
                            and (length := end - start) >= min_ms
                            and (chars / (length / 1000) if length > 0 else 0) <= fastest
                        )
                    ):
                        end, chars = upto, total
                        if shuts[at] is not None:
                            closes = shuts[at]
                        continue
                    if span > max_ms and total <= capacity and begin - end <= MAX_JOIN_GAP_MS:
                        lim.over = True
                    break
                else:
                    at = n
            if at == n:
                break
            done = Seg(start, end, "".join(parts + bodies[since:at]), (*held, *places[since:at]), chars)
            since, fresh, parts, held = at, True, [], []
            start, end, chars, closes, at = starts[at], ends[at], counts[at], bool(shuts[at]), at + 1
            self.start, self.rows = start, places[since:at]
            yield done
        self.start, self.end, self.chars = start, end, chars
        self.parts, self.rows = parts + bodies[since:], held + places[since:]

    def _complete(self):
        lim, length = self.limits, self.end - self.start
        return (
            self.chars >= 4
            and length >= lim.min_ms
            and lim.rate(self.chars, length) <= lim.max_speed
            and lim.closes_sentence("".join(self.parts))
        )

    def flush(self):
        return list(self.held)

    @property
    def held(self):
        return (Seg(self.start, self.end, "".join(self.parts), tuple(self.rows), self.chars),) if self.rows else ()

    @property
    def earliest(self):
        return self.start if self.rows else math.inf


class SplitLong(Step):
    """Cut over-long segments after punctuation, sharing time by characters."""

    earliest = math.inf

    def __init__(self, limits: Limits):
        self.limits = limits

    def swap(self, seg, floor):
        return seg if seg.chars <= self.limits.capacity and seg.end - seg.start <= self.limits.max_ms else None

    def push(self, seg):
        lim, text = self.limits, seg.text
        if seg.chars <= lim.capacity and lim.short_enough(seg.end - seg.start):
            return [seg]
        per_char = seg.length / max(1, len(text))
        at = lambda i: seg.start + int(i * per_char)
        cuts = [m.end() for m in lim.split_at.finditer(text)] or [len(text) // 2]
        parts, begin = [], 0
        for cut in cuts:
            if lim.count(text[begin:cut]) >= 4:
                parts.append(lim.seg(at(begin), at(cut), text[begin:cut].strip(), seg.rows))
                begin = cut
        rest = text[begin:]
        if rest.strip():
            if lim.count(rest) >= 2:
                parts.append(lim.seg(at(begin), seg.end, rest.strip(), seg.rows))
            elif parts:
                tail = parts.pop()
                parts.append(lim.seg(tail.start, seg.end, tail.text + rest.strip(), seg.rows))
        return parts or [seg]


class _Pairing(Step):
    """Common shape of the steps that may join a segment to its neighbours.

    ``last`` is the latest result, still open to a backward join; ``waiting``
    is a segment whose fate depends on its successor.
    """

    def __init__(self, limits: Limits):
        self.limits, self.last, self.waiting = limits, None, None

    def needs_care(self, seg: Seg) -> bool:
        raise NotImplementedError

    def before_next(self, seg: Seg) -> bool:
        """Try to settle ``seg`` without its successor; True if it was joined back."""
        return False

    def after_next(self, seg: Seg, following: Seg | None) -> list[Seg]:
        """Settle ``seg`` when the forward join was not possible."""
        return self.put(seg)

    def put(self, seg: Seg) -> list[Seg]:
        released = [self.last] if self.last else []
        self.last = seg
        return released

    def join_back(self, seg: Seg) -> bool:
        if self.last and self.limits.pair_fits(self.last, seg):
            self.last = self.last.joined(seg)
            return True
        return False

    def swap(self, seg, floor):
        if self.waiting or not self.last or self.needs_care(seg):
            return None
        last, self.last = self.last, seg
        return last

    def push(self, seg):
        released = []
        if self.waiting:
            held, self.waiting = self.waiting, None
            if self.limits.pair_fits(held, seg):
                return self.put(held.joined(seg))
            released = self.after_next(held, seg)
        if not self.needs_care(seg):
            return released + self.put(seg)
        if not self.before_next(seg):
            self.waiting = seg
        return released

    def flush(self):
        released = []
        if self.waiting:
            held, self.waiting = self.waiting, None
            released = self.after_next(held, None)
        return released + ([self.last] if self.last else [])

    @property
    def held(self):
        return tuple(s for s in (self.last, self.waiting) if s)

    @property
    def earliest(self):
        start = self.last.start if self.last else math.inf
        return min(start, self.waiting.start) if self.waiting else start


class LengthenShort(_Pairing):
    """Too short to show: join back, else forward, else extend into the gap."""

    def needs_care(self, seg):
        return seg.end - seg.start < self.limits.shortest

    def before_next(self, seg):
        return self.join_back(seg)

    def after_next(self, seg, following):
        shortest, gap = self.limits.shortest, self.limits.gap
        if following is None:
            end = seg.start + shortest
        else:
            room = following.start - seg.end
            if room > 2 * gap:
                room = room - gap
            else:
                room = room // 2 if room > 0 else 0
            end = seg.end + min(room, shortest - seg.length)
        return self.put(seg._replace(end=end))


class InStartOrder(Step):
    """Restore order by start after splits. A segment is released once no later
    one can start before it; ties keep arrival order."""

    def __init__(self):
        self.queue: list[Seg] = []

    def push(self, seg):
        queue = self.queue
        at = len(queue)
        while at and queue[at - 1].start > seg.start:
            at -= 1
        queue.insert(at, seg)
        return []

    def swap(self, seg, floor):
        return seg if not self.queue and seg.start <= floor else None

    def release(self, floor: float) -> list[Seg]:
        n = 0
        for seg in self.queue:
            if seg.start > floor:
                break
            n += 1
        out, self.queue = self.queue[:n], self.queue[n:]
        return out

    def flush(self):
        return self.release(math.inf)

    @property
    def held(self):
        return tuple(self.queue)


class JoinFast(_Pairing):
    """Too fast to read: join forward, else back. The last one is left alone."""

    def needs_care(self, seg):
        lim = self.limits
        return lim.rate(seg.chars, seg.end - seg.start) > lim.max_speed

    def after_next(self, seg, following):
        if following is not None and self.join_back(seg):
            return []
        return self.put(seg)


class JoinFragments(_Pairing):
    """Fragments join forward, else back; those ending in an interjection try back first."""

    def needs_care(self, seg):
        chars, lim = seg.chars, self.limits
        if chars <= 3 or seg.end - seg.start < lim.shortest:
            return True
        text = seg.text.strip() if chars <= 5 else ""
        return text != "" and text[:1] in lim.params.fragment_starters

    def before_next(self, seg):
        return seg.text[-1:] != "" and seg.text[-1] in self.limits.params.backward_endings and self.join_back(seg)

    def after_next(self, seg, following):
        return [] if self.join_back(seg) else self.put(seg)


STEPS: dict[str, Callable[[Limits], Step]] = {
    "join_short": JoinShort,
    "split_long": SplitLong,
    "lengthen_short": LengthenShort,
    "start_order": lambda limits: InStartOrder(),
    "join_fast": JoinFast,
    "join_fragments": JoinFragments,
}
FULL_CHAIN = ("join_short", "split_long", "lengthen_short", "start_order", "join_fast", "join_fragments")


class SegmentChain(Fold):
    """Chained steps as one fold over rows ``pos, start_ms, end_ms, text``.

    ``pos`` may be renamed; ``rows`` of an output are the input positions.
    """

    def __init__(self, names: Sequence[str], params: SubtitleParams, pos: str = "pos"):
        self.limits = Limits(params)
        self.steps = [STEPS[n](self.limits) for n in names]
        self.pos = pos
        self.newest = -math.inf
        self.ordering = {i for i, step in enumerate(self.steps) if isinstance(step, InStartOrder)}
        self.first_orders, self.last_ordering = 0 in self.ordering, max(self.ordering, default=-1)

    def under(self, limits: Limits) -> "SegmentChain":
        """A copy in the same state that goes on under other limits."""
        twin = copy.copy(self)
        twin.limits, twin.steps = limits, [step.under(limits) for step in self.steps]
        return twin

    def push(self, row):
        return self.take(self.segment(row))

    def segment(self, row) -> Seg:
        text = row["text"]
        return Seg(row["start_ms"], row["end_ms"], text, (row[self.pos],), self.limits.count(text))

    def take(self, seg: Seg) -> list[tuple]:
        """Pass a segment on. What waits for its order is looked at when the first step releases something."""
        self.newest = seg.start
        segs = self.steps[0].push(seg)
        if self.first_orders:
            segs = segs + self.steps[0].release(self._floor(0))
        return self._through(segs, 1) if segs else []

    def push_many(self, columns, first, stop):
        return self.take_rows(Rows(columns, self.pos, first, stop, self.limits)) if first < stop else []

    def take_rows(self, rows: Rows) -> list[tuple]:
        """Pass rows on, together where the first step can take them so."""
        out, entrance = [], self.steps[0]
        if not isinstance(entrance, JoinShort):
            return [made for seg in rows.segments() for made in self.take(seg)]
        for seg in entrance.push_rows(rows):
            self.newest = entrance.start
            out += self._swapped(seg)
        self.newest = rows.start[-1]
        return out

    def _swapped(self, seg: Seg) -> list[tuple]:
        """A segment of the first step through all others, which mostly just swap it."""
        for i, step in enumerate(self.steps):
            if i:
                out = step.swap(seg, self._floor(i) if i in self.ordering else 0)
                if out is None:
                    return self._through([seg], i)
                seg = out
        return self._rows([seg])

    def _through(self, segs, first):
        for i in range(first, len(self.steps)):
            step = self.steps[i]
            if segs:
                segs = step.push(segs[0]) if len(segs) == 1 else [out for seg in segs for out in step.push(seg)]
            if i in self.ordering and step.queue:
                segs = step.release(self._floor(i))
            elif not segs and i > self.last_ordering:
                return segs
        return self._rows(segs) if segs else segs

    def _floor(self, at):
        """No segment still to come in front of step ``at`` starts before this."""
        floor = self.newest
        for step in self.steps[:at]:
            floor = min(floor, step.earliest)
        return floor

    def flush(self):
        out = []
        for i, step in enumerate(self.steps):
            out += self._through(step.flush(), i + 1)
        return out

    def state(self):
        return tuple(tuple((s.start, s.end, s.text, s.rows) for s in step.held) for step in self.steps)

    def _rows(self, segs: list[Seg]) -> list[tuple]:
        return [(seg.start, seg.end, seg.text, list(seg.rows)) for seg in segs]


class BesideChain(SegmentChain):
    """Each result with the previous one and the start of the next, which is all that timing and
    the checks of alignment look at. The previous text is given where the two overlap, the only place where it is read."""

    before = last = None

    def _rows(self, segs):
        out = []
        for seg in segs:
            if self.last:
                out.append(self._beside(seg.start))
            self.before, self.last = self.last, seg
        return out

    def _beside(self, following):
        seg, before = self.last, self.before
        if before is None:
            return (seg.start, seg.end, seg.text, seg.chars, following, None, None, None, None)
        text = before.text if before.end > seg.start else None
        return (seg.start, seg.end, seg.text, seg.chars, following, before.start, before.end, before.chars, text)

    def flush(self):
        out = super().flush()
        return out + [self._beside(None)] if self.last else out

    def state(self):
        return (super().state(), tuple((s.start, s.end, s.text, s.rows) for s in (self.before, self.last) if s))


SEGMENT_FIELDS = [
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source_rows", T.ArrayType(T.LongType())),
]
BESIDE_FIELDS = [
    *SEGMENT_FIELDS[:3],
    T.StructField("chars", T.LongType()),
    T.StructField("next_start_ms", T.LongType()),
    T.StructField("prev_start_ms", T.LongType()),
    T.StructField("prev_end_ms", T.LongType()),
    T.StructField("prev_chars", T.LongType()),
    T.StructField("prev_text", T.StringType()),
]


def run_steps(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[str],
    params: SubtitleParams = SubtitleParams(),
    pos: str = "pos",
    total: str = "n_rows",
    **options,
) -> DataFrame:
    """Apply merge steps to each key in ``pos`` order.

    Returns ``start_ms, end_ms, text, source_rows`` (positions of the rows each
    result was made of), with ``pos`` and ``n_rows`` renumbered.
    """
    names = list(steps)
    rows = df.select(*keys, pos, total, "start_ms", "end_ms", "text")
    folded = ordered_fold(
        rows, keys, pos, total, lambda key: SegmentChain(names, params, pos), SEGMENT_FIELDS,
        name="segments", **options,
    )
    return _numbered(folded, keys)


@lru_cache(maxsize=8)
def _bands(settings: tuple[tuple[str, SubtitleParams], ...]) -> list[list[tuple[Limits, list[str]]]]:
    """Settings that differ at most in the time on screen: their limits, shortest time first, each with the settings' names."""
    bands: dict[SubtitleParams, dict[float, list[str]]] = {}
    for k, p in settings:
        bands.setdefault(p.with_values(max_display_s=0.0), {}).setdefault(p.max_display_s, []).append(k)
    return [[(Limits(p.with_values(max_display_s=most)), ks) for most, ks in sorted(levels.items())] for p, levels in bands.items()]


class ManyChains(Fold):
    """The same steps under several settings over one pass of the rows.

    Characters are counted once for all settings that count the same ones. Settings that differ at most in
    the time on screen share one chain, that of the shortest, until something is too long for it: then
    the others go on with a copy of it from before these rows. ``together`` gives the names of all settings
    that share a result as one list."""

    def __init__(
        self, names: Sequence[str], settings: Mapping[str, SubtitleParams], pos: str, chain: type[SegmentChain] = SegmentChain, together: bool = False
    ):
        self.order, self.together = list(settings), together
        # per class of characters, chains with the settings that share them
        self.alike: dict[str, list[tuple[SegmentChain, list[tuple[Limits, list[str]]]]]] = {}
        for sharing in _bands(tuple(settings.items())):
            limits = sharing[0][0]
            self.alike.setdefault(limits.params.count_class, []).append((chain(names, limits.params, pos).under(limits), list(sharing)))

    def _advance(self, chains: list, act: Callable[[SegmentChain], list[tuple]]) -> list[tuple]:
        """Let every chain act; those that no longer hold for all their settings are parted."""
        out, todo = [], chains[::-1]
        chains.clear()
        while todo:
            chain, sharing = todo.pop()
            before = chain.under(sharing[1][0]) if len(sharing) > 1 else None
            chain.limits.over = False
            made = act(chain)
            if before and chain.limits.over:
                todo.append((before, sharing[1:]))
                sharing = sharing[:1]
            chains.append((chain, sharing))
            ks = [k for _, level in sharing for k in level]
            out += [(ks, *values) for values in made] if self.together else [(k, *values) for k in ks for values in made]
        return out

    def push(self, row):
        out = []
        for chains in self.alike.values():
            seg = chains[0][0].segment(row)
            out += self._advance(chains, lambda chain: chain.take(seg))
        return out

    def push_many(self, columns, first, stop):
        out = []
        for chains in self.alike.values() if first < stop else ():
            rows = Rows(columns, chains[0][0].pos, first, stop, chains[0][0].limits)
            out += self._advance(chains, lambda chain: chain.take_rows(rows))
        return out

    def flush(self):
        return [made for chains in self.alike.values() for made in self._advance(chains, lambda chain: chain.flush())]

    def state(self):
        states = {}
        for chain, sharing in (c for chains in self.alike.values() for c in chains):
            states |= dict.fromkeys((k for _, level in sharing for k in level), chain.state())
        return tuple(states[k] for k in self.order)


def run_settings(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[str],
    settings: Mapping[str, SubtitleParams],
    pos: str = "pos",
    total: str = "n_rows",
    **options,
) -> DataFrame:
    """:func:`run_steps` under every setting, with the setting's name in
    ``param_id``. The rows are shuffled and read once, not once per setting."""
    chosen, names = dict(settings), list(steps)
    rows = df.select(*keys, pos, total, "start_ms", "end_ms", "text")
    fields = [T.StructField("param_id", T.StringType()), *SEGMENT_FIELDS]
    folded = ordered_fold(rows, keys, pos, total, lambda key: ManyChains(names, chosen, pos), fields, name="sweep", **options)
    return _renumber(folded, ["param_id", *keys])


def run_settings_beside(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[str],
    settings: Mapping[str, SubtitleParams],
    pos: str = "pos",
    total: str = "n_rows",
    **options,
) -> DataFrame:
    """:func:`run_settings` for a look at neighbours only: every result has the previous one and the start
    of the next beside it, so none is ranked or shuffled again. ``pos`` orders those of a setting and key.
    What settings share is one row, with their names in ``param_ids``."""
    chosen, names = dict(settings), list(steps)
    rows = df.select(*keys, pos, total, "start_ms", "end_ms", "text")
    fields = [T.StructField("param_ids", T.ArrayType(T.StringType())), *BESIDE_FIELDS]
    folded = ordered_fold(
        rows, keys, pos, total, lambda key: ManyChains(names, chosen, pos, BesideChain, True), fields, name="sweep", **options
    )
    at = F.col("_block") * (1 << 40) + F.col("_seq")  # a number, as a struct can't be aggregated without sorting
    return folded.select("param_ids", *keys, at.alias("pos"), *[f.name for f in BESIDE_FIELDS])


def _numbered(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions of the results of a fold whose ``_seq`` counts the results of a block
    from 0: only block sizes are added up, no row is ranked again."""
    sizes = folded.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy("_block")) - F.col("_n")
    offsets = sizes.select(*keys, "_block", before.alias("_before"), F.sum("_n").over(whole).alias("n_rows"))
    rows = folded.join(offsets, [*keys, "_block"]).withColumn("pos", F.col("_before") + F.col("_seq"))
    return rows.select(*keys, *[f.name for f in SEGMENT_FIELDS], "n_rows", "pos")


def _renumber(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions of the results of each setting in the order in which the steps released them."""
    return dense_position(folded, keys, ["_block"], ["_seq"], "pos", "n_rows").drop("_block", "_seq")


def merge_short_segments(df, keys, params=SubtitleParams(), **options) -> DataFrame:
    return run_steps(df, keys, ["join_short"], params, **options)


def split_long_segments(
    df: DataFrame, keys: Sequence[str], params: SubtitleParams = SubtitleParams(), pos: str = "pos", size: int = BLOCK_ROWS
) -> DataFrame:
    """Over-long segments cut into parts, numbered anew. A segment is split by itself,
    so this is a projection; only the numbering moves rows."""
    keys = list(keys)
    rows = df.select(*keys, F.col(pos).cast("bigint").alias("_at"), "start_ms", "end_ms", "text")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_at", T.LongType()), T.StructField("_part", T.LongType()), *SEGMENT_FIELDS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = SplitLong(Limits(params))
        for batch in batches:
            at, columns = [], [[], [], [], [], []]
            for i, (place, start, end, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_at", "start_ms", "end_ms", "text")))):
                for part, seg in enumerate(step.push(step.limits.seg(start, end, text, (place,)))):
                    at.append(i)
                    for column, value in zip(columns, (part, seg.start, seg.end, seg.text, list(seg.rows))):
                        column.append(value)
            taken = batch.select([*keys, "_at"]).take(pa.array(at, pa.int64()))
            made = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys) + 1 :])]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], schema=arrow)

    parts = rows.mapInArrow(run, schema).withColumn("_block", F.floor(F.col("_at") / size))
    return dense_position(parts, keys, ["_block"], ["_at", "_part"], "pos", "n_rows").drop("_block", "_at", "_part")


def ensure_minimum_duration(df, keys, params=SubtitleParams(), **options) -> DataFrame:
    return run_steps(df, keys, ["lengthen_short"], params, **options)


def merge_fast_segments(df, keys, params=SubtitleParams(), **options) -> DataFrame:
    return run_steps(df, keys, ["join_fast"], params, **options)


def merge_tiny_fragments(df, keys, params=SubtitleParams(), **options) -> DataFrame:
    return run_steps(df, keys, ["join_fragments"], params, **options)


def transcript_to_entries(
    df: DataFrame, keys: Sequence[str], params: SubtitleParams = SubtitleParams(), **options
) -> DataFrame:
    """Segments in time order to numbered subtitle entries: the full merge chain,
    then gaps, then longer display of fast entries. Adds ``index`` from 1."""
    merged = run_steps(df, keys, FULL_CHAIN, params, **options)
    timed = finish_timing(merged, keys, "pos", params)
    return timed.withColumn("index", F.col("pos") + 1)


# -- predicates over pairs ------------------------------------------------------------


def should_merge(
    text_a: Column, start_a: Column, end_a: Column, text_b: Column, start_b: Column, end_b: Column, params: SubtitleParams
) -> Column:
    """Close enough, few enough characters and short enough together."""
    return (
        (start_b - end_a <= MAX_JOIN_GAP_MS)
        & (counted(F.concat(text_a, text_b), params.count_class) <= params.capacity)
        & (end_b - start_a <= params.max_display_s * 1000)
    )


def pair_fits(text_a: Column, start_a: Column, text_b: Column, end_b: Column, params: SubtitleParams) -> Column:
    """As :func:`should_merge` without the gap test, with a speed test."""
    chars = counted(F.concat(text_a, text_b), params.count_class)
    return (
        (chars <= params.capacity)
        & (end_b - start_a <= params.max_display_s * 1000)
        & (speed(chars, end_b - start_a, 0.0) <= params.max_speed)
    )


def is_fragment(text: Column, duration_ms: Column, params: SubtitleParams) -> Column:
    body = strip(text)
    chars = counted(body, params.count_class)
    return (
        (chars <= 3)
        | (duration_ms < params.min_display_ms)
        | ((chars <= 5) & body.rlike("^" + char_class(params.fragment_starters)))
    )


def merge_candidates(df: DataFrame, keys: Sequence[str], params: SubtitleParams, pos: str = "pos", **options) -> DataFrame:
    """Each segment with its successor and the three merge predicates."""
    rows = over_neighbours(
        df, keys, pos,
        {
            "next_start_ms": lambda w: F.lead("start_ms").over(w),
            "next_end_ms": lambda w: F.lead("end_ms").over(w),
            "next_text": lambda w: F.lead("text").over(w),
        },
        before=0, after=1, **options,
    )
    text, start, end = F.col("text"), F.col("start_ms"), F.col("end_ms")
    nxt = (F.col("next_text"), F.col("next_start_ms"), F.col("next_end_ms"))
    return rows.where("next_start_ms is not null").withColumns(
        {
            "should_merge": should_merge(text, start, end, *nxt, params),
            "pair_fits": pair_fits(text, start, nxt[0], nxt[2], params),
            "is_fragment": is_fragment(text, end - start, params),
            "ends_sentence": ends_sentence(text, params.sentence_end),
        }
    )


# -- processed clip entries -----------------------------------------------------------


class ClipEntries(Fold):
    """Merge short processed entries of a clip, then remove overlaps.

    First part: an entry shorter than ``min_s`` is appended to the previous one
    if the text fits, else both get ``extend_s``; the very first may absorb its
    successor. Second part: an overlap ends 0.04 s before the next start, or,
    if the two start within a second, both meet 0.02 s around the middle.
    Finally a short entry is lengthened up to the next start.
    """

    def __init__(self, max_chars: int, min_s: float, extend_s: float):
        self.max_chars, self.min_s, self.extend_s = max_chars, min_s, extend_s
        self.prev = None  # latest merged entry: (start, end, text)
        self.first = None  # a short first entry that waits for its successor
        self.shown = None  # latest entry of the second part

    def push(self, row):
        entry = (row["start_s"], row["end_s"], row["text"])
        released = []
        if self.first is not None:
            first, self.first = self.first, None
            if len(first[2] + entry[2]) <= self.max_chars:
                self.prev = (first[0], entry[1], first[2] + entry[2])
                entry = (entry[0], entry[1], "")
            else:
                self.prev = (first[0], first[0] + self.extend_s, first[2])
        if entry[1] - entry[0] >= self.min_s:
            return self._advance(entry) if entry[2] else released
        if self.prev is None:
            self.first = entry
            return released
        start, end, text = self.prev
        if len(text + entry[2]) <= self.max_chars:
            self.prev = (start, entry[1], text + entry[2])
            return released
        self.prev = (start, min(end, start + self.extend_s), text)
        return self._advance((entry[0], entry[0] + self.extend_s, entry[2]))

    def _advance(self, entry):
        done, self.prev = self.prev, entry
        return self._separate(done) if done and done[2] else []

    def _separate(self, entry):
        if self.shown is None:
            self.shown = entry
            return []
        (start, end, text), (nstart, nend, ntext) = self.shown, entry
        if end > nstart:
            if nstart - start >= 1.0:
                end = nstart - 0.04
            else:
                middle = (start + nstart) / 2
                end, nstart = middle - 0.02, middle + 0.02
        if end - start < self.min_s:
            end = min(start + self.min_s, nstart - 0.04)
        self.shown = (nstart, nend, ntext)
        return [(start, end, text)]

    def flush(self):
        out = []
        if self.first is not None:
            self.prev, self.first = (self.first[0], self.first[0] + self.extend_s, self.first[2]), None
        if self.prev and self.prev[2]:
            out += self._separate(self.prev)
        if self.shown:
            start, end, text = self.shown
            out.append((start, start + self.min_s if end - start < self.min_s else end, text))
        return out

    def state(self):
        return (self.prev, self.first, self.shown)


def merge_clip_entries(
    df: DataFrame,
    keys: Sequence[str],
    max_chars: int = 18,
    min_s: float = 1.0,
    extend_s: float = 1.2,
    pos: str = "clip_pos",
    total: str = "n_rows",
    **options,
) -> DataFrame:
    """Processed entries (``start_s, end_s, text``) of each clip, merged, without
    overlaps and numbered from 1 in ``index``."""
    fields = [
        T.StructField("start_s", T.DoubleType()),
        T.StructField("end_s", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
    rows = df.select(*keys, pos, total, F.col("start_s").cast("double"), F.col("end_s").cast("double"), "text")
    merged = ordered_fold(
        rows, keys, pos, total, lambda key: ClipEntries(max_chars, min_s, extend_s), fields, name="clip-entries", **options
    )
    numbered = dense_position(merged, keys, ["_block"], ["_seq"], "_pos").withColumn("index", F.col("_pos") + 1)
    return numbered.drop("_block", "_seq", "_pos")
