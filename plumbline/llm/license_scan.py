"""License scans by a generalised suffix automaton of licence words.

The automaton holds every run of consecutive words of all templates and phrases.  A text's words go through it one by one;
after each, the state tells the longest run ending there that some template has.  That is the text's matching statistics,
in time proportional to its length however much it repeats.  Runs that can't be extended and are long enough are chained:
runs of one template that follow each other in text and template, with few words between them, make a span, which counts
if it covers enough of the template.  A phrase stands where a run ends whose state is the phrase's or below it in the tree
of suffix links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.license_texts import PHRASES, TEMPLATES

LEAST_RUN = 4
MOST_GAP = 12
LEAST_COVER = 0.6
MENTION = 0.5
PIECE_BYTES = 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
Labelled = tuple[tuple[str, str], ...]


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size: runs of 0-9, a-z and characters beyond ASCII, A-Z being lower-cased."""
    data = text.encode("utf-8", "replace").lower()
    at = 0
    while at < len(data):
        stop = _BREAK.search(data, min(len(data), at + PIECE_BYTES))
        end = stop.start() if stop else len(data)
        yield _WORD.findall(data, at, end)
        at = end + 1


@dataclass(slots=True)
class Chain:
    """A run of words of a text that a template has, and the best chain of such runs that ends with it."""

    end: int
    template_start: int
    template_end: int
    start: int  # of the chain
    covered: int
    followed: bool = False


@dataclass(frozen=True)
class Span:
    """Words start to end - 1 of a text, with so many words of a template."""

    template: int
    start: int
    end: int
    covered: int
    cover: float


class Automaton:
    """All runs of words of the templates and phrases, and where they end."""

    def __init__(self, templates: Labelled, phrases: Labelled):
        self.number: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        texts = [self._numbers(t) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        named = [self._numbers(p) for p, _ in phrases]
        for t in texts + named:
            state = 0
            for word in t:
                state = self._extend(state, word)
        # clones are made until the last insertion, so ends are attached when all states stand
        self._attach(texts, named)

    def _numbers(self, text: str) -> list[int]:
        return [self.number.setdefault(w, len(self.number)) for part in word_lists(text) for w in part]

    def _clone(self, state: int, longest: int) -> int:
        self.step.append(dict(self.step[state]))
        self.link.append(self.link[state])
        self.longest.append(longest)
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of what ``last`` stands for with one more word."""
        step, link, longest = self.step, self.link, self.longest
        there = step[last].get(word)
        if there is None:
            new = len(step)
            step.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at >= 0:
                link[new] = self._split(at, word)
            return new
        return self._split(last, word)

    def _split(self, at: int, word: int) -> int:
        """The state whose longest run is that of ``at`` and this word; it is cut from a longer one where need be."""
        step, link, longest = self.step, self.link, self.longest
        there = step[at][word]
        if longest[there] == longest[at] + 1:
            return there
        copy = self._clone(there, longest[at] + 1)
        while at >= 0 and step[at].get(word) == there:
            step[at][word] = copy
            at = link[at]
        link[there] = copy
        return copy

    def _attach(self, texts: list[list[int]], phrases: list[list[int]]) -> None:
        """Where each state's runs end, as a slice of one list in the order of the link tree; and the phrases by state."""
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(texts):
            state = 0
            for i, word in enumerate(t):
                state = self.step[state][word]
                own[state].append((k, i + 1))
        below: dict[int, list[int]] = defaultdict(list)
        for state in range(1, len(self.step)):
            below[self.link[state]].append(state)
        self.ends: list[tuple[int, int]] = []
        self.slice = [(0, 0)] * len(self.step)
        ending: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, p in enumerate(phrases):
            state = 0
            for word in p:
                state = self.step[state][word]
            ending[state].append((k, len(p)))
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        stack, begun = [(0, False)], {}
        while stack:
            state, done = stack.pop()
            if done:
                self.slice[state] = (begun[state], len(self.ends))
                continue
            begun[state] = len(self.ends)
            self.ends += own.get(state, [])
            self.phrases[state] = (self.phrases[self.link[state]] if state else ()) + tuple(ending.get(state, ()))
            stack.append((state, True))
            stack += [(s, False) for s in below.get(state, ())]

    def runs_and_phrases(self, lists: Iterator[list[bytes]], least: int) -> Iterator[tuple[str, int, int, int]]:
        """("run", start, end, state) of runs of ``least`` words or more that no next word extends, and ("phrase", start,
        end, phrase), as their ends are reached; at last ("end", words, words, 0)."""
        step, link, longest, phrases, number = self.step, self.link, self.longest, self.phrases, self.number
        state = size = i = 0
        for words in lists:
            for word in map(number.get, words):
                if word is None:
                    if size:
                        if size >= least:
                            yield "run", i - size, i, state
                        state = size = 0
                    i += 1
                    continue
                there = step[state].get(word)
                if there is None:
                    if size >= least:
                        yield "run", i - size, i, state
                    while there is None and state:
                        state = link[state]
                        there = step[state].get(word)
                    size = longest[state]
                if there is None:
                    size = 0
                else:
                    state = there
                    size += 1
                    for phrase, n in phrases[state]:
                        if size >= n:
                            yield "phrase", i + 1 - n, i + 1, phrase
                i += 1
        if size >= least:
            yield "run", i - size, i, state
        yield "end", i, i, 0

    def scan(self, text: str, least: int, gap: int, cover: float) -> tuple[int, list[tuple[int, int]], list[Span]]:
        """Number of words, (phrase, first word) of every place, and the spans, of which none is mostly within a better one."""
        places: list[tuple[int, int]] = []
        waiting: dict[int, list[Chain]] = defaultdict(list)
        found: list[Span] = []
        n = 0

        def close(template: int, chains: list[Chain]) -> None:
            for c in chains:
                if not c.followed and c.covered >= cover * self.sizes[template]:
                    found.append(Span(template, c.start, c.end, c.covered, c.covered / self.sizes[template]))

        for kind, start, end, what in self.runs_and_phrases(word_lists(text), least):
            if kind == "phrase":
                places.append((what, start))
            elif kind == "end":
                n = end
            else:
                first, last = self.slice[what]
                size = end - start
                old: dict[int, list[Chain]] = {}
                for template, t_end in self.ends[first:last]:
                    if template not in old:
                        chains = waiting[template]
                        close(template, [c for c in chains if c.end < start - gap])
                        old[template] = [c for c in chains if c.end >= start - gap]
                        waiting[template] = list(old[template])
                    t_start = t_end - size
                    best, gained = None, 0
                    for c in old[template]:
                        more = min(end - max(start, c.end), t_end - max(t_start, c.template_end))
                        if more > 0 and t_start > c.template_start and t_start - c.template_end <= gap and c.covered + more > gained:
                            best, gained = c, c.covered + more
                    if best is None or gained < size:
                        waiting[template].append(Chain(end, t_start, t_end, start, size))
                    else:
                        best.followed = True
                        waiting[template].append(Chain(end, t_start, t_end, best.start, gained))
        for template, chains in waiting.items():
            close(template, chains)
        return n, places, apart(found)


def apart(spans: list[Span]) -> list[Span]:
    """Spans in order of their start, taken by covered words, but none that a taken one covers by half or more."""
    out: list[Span] = []
    for group in overlapping(sorted(spans, key=lambda s: (s.start, s.end))):
        taken: list[Span] = []
        for s in sorted(group, key=lambda s: (-s.covered, -s.cover, s.start, s.template)):
            if all(2 * (min(t.end, s.end) - max(t.start, s.start)) < s.end - s.start for t in taken):
                taken.append(s)
        out += taken
    return sorted(out, key=lambda s: (s.start, s.template))


def overlapping(spans: list[Span]) -> Iterator[list[Span]]:
    """Spans, in order of their start, in groups that have no word in common."""
    group: list[Span] = []
    end = 0
    for s in spans:
        if group and s.start >= end:
            yield group
            group = []
        group.append(s)
        end = max(end, s.end)
    if group:
        yield group


@lru_cache(maxsize=4)
def automaton(templates: Labelled, phrases: Labelled) -> Automaton:
    """Kept by the worker process from one task to the next."""
    return Automaton(templates, phrases)


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("cover", pa.float64())]))


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Sequence[tuple[str, str]] = tuple(PHRASES),
    *,
    least_run: int = LEAST_RUN,
    most_gap: int = MOST_GAP,
    least_cover: float = LEAST_COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's id, n_words, places, spans and score.

    places: label and first word of every place where a phrase's words stand consecutively, by last word.  spans: label,
    start, end, covered, cover of parts of the text with so many words of a template, ``cover`` being their share of it,
    ``least_cover`` or more; they are made of runs of ``least_run`` words or more, up to ``most_gap`` words apart, so added
    or changed words don't hide a notice.  Of spans over the same words the one that covers most is given.  score: the
    largest cover; at least MENTION where a phrase stands; 0 where nothing does.  Null and empty texts have no words.  Rows
    are independent; other columns aren't kept, so their names can't clash.
    """
    known, named = tuple(map(tuple, templates)), tuple(map(tuple, phrases))

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = automaton(known, named)
        for batch in batches:
            n, places, spans, score = [], [], [], []
            for text in batch.column("text"):
                size, where, parts = of.scan(text.as_py() or "", least_run, most_gap, least_cover)
                n.append(size)
                places.append([{"label": of.phrase_labels[k], "word": w} for k, w in where])
                spans.append([{"label": of.labels[s.template], "start": s.start, "end": s.end, "covered": s.covered, "cover": s.cover} for s in parts])
                score.append(max([MENTION if where else 0.0, *(s.cover for s in parts)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(spans, _SPANS), pa.array(score, pa.float64())], ["id", "n_words", "places", "spans", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = "places array<struct<label string, word bigint>>, spans array<struct<label string, start bigint, `end` bigint, covered bigint, cover double>>"
    found = rows.mapInArrow(scan_batches, f"id {kind}, n_words bigint, {fields}, score double")
    return found.withColumnRenamed("id", id_col)
