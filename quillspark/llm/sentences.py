"""Problem 4: sentence boundaries across languages and scripts.

Every character is tagged as boundary or inside by a linear-chain model; only characters
after a final mark, a closed quotation or, in Thai, at a space can score as boundary, so
the Viterbi search runs over those. The model's tables (what stands before a mark that
surely ends a sentence, what a sentence surely begins with) and its weights are learned
on all texts from what is sure without labels: beginnings and ends of blocks, blocks
joined to one another, and marks before a lower-case continuation. For Thai, which has
no final marks, blocks are joined by a bare space. Tasks count tokens and sure cases;
cases of equal features are one with a number, so the driver learns from few rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import unmarked
from quillspark.llm.corpus import current_documents
from quillspark.llm.split import Tree
from quillspark.llm.unmarked import UNSPACED, UnmarkedModel
from quillspark.runtime import checkpoint, ship

FORMATS = ("md", "docx", "txt")
#: From how many characters on a block of an unspaced script without any candidate is left to the unmarked chain.
UNMARKED_CHARS = 160
#: Step of the weights; parts in which the cases of a round of learning come; steps up and down that the transition may go.
STEP, SLICES, MOST_STEPS = 0.05, 50, 800
#: Sightings from which on more don't change the evidence of a token.
MOST_SEEN = 100
#: Counted entries that a task holds before it hands them on.
HELD = 200_000

# Final marks, quotation marks and closing brackets.
MARKS = ".!?…。！？।؟"
PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", '"': '"'}
QUOTES = "«“„「『\""
CLOSERS = "\"”’»)]」』“'"

_BLANK = re.compile(r"[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*")
_HEADING = re.compile(r"^[ \t]*#[^\n]*", re.M)
_CANDIDATE = re.compile(r"[.!?…。！？।؟]+|[»”」』\"“]|(?<=[฀-๿])[ \t\r\n]+(?=[฀-๿])")
_THAI = re.compile("[฀-๿]")
#: Where candidates begin in blocks without Thai; one class of characters is searched much faster than a choice.
_PLAIN = re.compile("[.!?…。！？।؟»”」』\"“]")
_BRACKET = re.compile("[«»“”„「」『』\"()\\[\\]]")
_NOT_OWN = "\"'«»“”„「」『』()[]¿¡"
_WHITE = " \t\r\n"
_GAPS = " \t\r\n\u00a0\u202f"


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans that no sentence crosses: lines of headings, and what lies between them and blank lines."""
    at = 0
    ends = [m.span() for m in _BLANK.finditer(text)] + [(len(text), len(text))]
    for stop, after in ends:
        begin = at
        if "#" in text[begin:stop]:
            for m in _HEADING.finditer(text, at, stop):
                if begin < m.start():
                    yield begin, m.start()
                yield m.span()
                begin = m.end()
        if begin < stop:
            yield begin, stop
        at = after


def is_heading(text: str, a: int) -> bool:
    return text[a:].lstrip(" \t")[:1] == "#" if a < len(text) else False


def quotations(block: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of the quotations and brackets that are closed in the block."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in _BRACKET.finditer(block):
        c, at = m[0], m.start()
        for depth in range(len(stack) - 1, -1, -1):
            if PAIRS[stack[depth][0]] == c:
                out.append((stack[depth][1], at))
                del stack[depth:]
                break
        else:
            if c in PAIRS:
                stack.append((c, at))
    return out


def _word_before(block: str, at: int) -> str:
    """The token that ends before ``at``, in lower case; numbers are one token."""
    b = at
    while b and (block[b - 1] in MARKS or block[b - 1] in CLOSERS):
        b -= 1
    a = b
    while a and block[a - 1] not in _GAPS and block[a - 1] not in _NOT_OWN and b - a < 24:
        a -= 1
    word = block[a:b].lower()
    return "0" if word[-1:].isdigit() else word


def _word_after(block: str, at: int) -> tuple[str, str]:
    """(class, token) of what follows: lower, upper, digit, letter without case, opening mark, or end."""
    n = len(block)
    while at < n and (block[at] in _GAPS or unicodedata.category(block[at]) in ("So", "Sk", "Cf", "Mn", "Pd")):
        at += 1
    opener = ""
    while at < n and block[at] in "«“„「『\"(¿¡'":
        opener = "opener"
        at += 1
    if at >= n:
        return "end", ""
    kind = unicodedata.category(block[at])
    if kind[0] == "N":
        return opener or "digit", "0"
    if kind[0] != "L":
        return opener or "mark", block[at]
    b = at
    dense = kind == "Lo" and block[at] >= "฀" and not "ऀ" <= block[at] <= "ॿ"
    while b < n and b - at < (2 if dense else 24) and (block[b].isalnum() or unicodedata.category(block[b])[0] == "M"):
        b += 1
    case = "lower" if kind == "Ll" else "upper" if kind in ("Lu", "Lt") else "letter"
    return opener or case, block[at:b].lower() if case == "letter" else block[at:b]


class Candidate:
    __slots__ = ("at", "mark", "inside", "closed", "gap", "before", "kind", "after")

    def __init__(self, at, mark, inside, closed, gap, before, kind, after):
        self.at, self.mark, self.inside, self.closed = at, mark, inside, closed
        self.gap, self.before, self.kind, self.after = gap, before, kind, after

    def asks_before(self) -> bool:
        return self.mark == "dot" and not self.closed

    def asks_after(self) -> bool:
        return self.mark != "space" and (self.kind == "letter" or self.kind == "upper" and self.gap == "none" and self.mark == "dot")


def _outermost(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the pairs that lie in no other one; pairs never cross."""
    starts: list[int] = []
    stops: list[int] = []
    for a, b in sorted(pairs):
        if not stops or a > stops[-1]:
            starts.append(a)
            stops.append(b)
    return starts, stops


def _last(block: str, at: int) -> str:
    """The last character before ``at`` that is no gap; a blank where there is none."""
    while at and block[at - 1] in _GAPS:
        at -= 1
    return block[at - 1] if at else " "


def candidates(block: str) -> list[Candidate]:
    """Places where a sentence may end within a block: ``at`` is the end of the sentence."""
    pairs = quotations(block)
    closing = {b: a for a, b in pairs}
    starts, stops = _outermost(pairs)
    out: list[Candidate] = []
    done, end = 0, len(block.rstrip(_WHITE))
    for m in (_CANDIDATE if _THAI.search(block) else _PLAIN).finditer(block):
        a, b = m.span()
        if a < done:
            continue
        if m[0][0] in _WHITE:  # a space between two Thai characters
            k = bisect_left(starts, a) - 1
            out.append(Candidate(a, "space", k >= 0 and a < stops[k], False, "space", "", "letter", ""))
            continue
        closed = False
        if m[0] in QUOTES or m[0] in PAIRS.values():
            # a closed quotation with a final mark as its last character
            if a not in closing or _last(block, a) not in MARKS:
                continue
            closed = True
        while b < len(block):
            c = block[b]
            if c in MARKS:
                b += 1
            elif c in CLOSERS and (b in closing or c in "’'"):
                closed |= c in "»”」』\"“"
                b += 1
            elif c in " \u00a0\u202f" and b + 1 < len(block) and block[b + 1] == "»" and b + 1 in closing:
                closed = True
                b += 2
            else:
                break
        done = b
        if b >= end:
            continue  # the end of the block, which ends a sentence anyway
        run = block[a:b]
        if run == ".":
            mark = "dot"
        else:
            marks = [c for c in run if c in MARKS] or [_last(block, a)]
            strong = any(c in "!?。！？।؟" for c in marks)
            dots = "…" in marks or marks.count(".") > 1
            mark = "strong" if strong else "dots" if dots else "dot"
        c = block[b]
        gap = "line" if c in "\r\n" else "space" if c in _GAPS else "none"
        kind, after = _word_after(block, b)
        if gap == "none" and mark == "dot" and c not in _NOT_OWN and not c.isalnum():
            continue
        k = bisect_left(starts, b) - 1
        inside = k >= 0 and b <= stops[k]
        out.append(Candidate(b, mark, inside, closed, gap, _word_before(block, a), kind, after))
    return out


def asks_chain(found: list[Candidate], block: str) -> bool:
    """Is the block one that the unmarked chain decides?"""
    return not found and len(block) >= UNMARKED_CHARS and len(UNSPACED.findall(block)) > 0.6 * len(block)


def best_path(at: list[int], emit: list[float], near: float) -> list[bool]:
    """Viterbi over the candidates of a block; two boundaries with no room between them are unlikely."""
    if not at:
        return []
    inside, boundary = 0.0, emit[0]
    back: list[tuple[bool, bool]] = [(False, False)]
    for k in range(1, len(at)):
        close = near if at[k] - at[k - 1] < 3 else 0.0
        from_boundary = boundary + close > inside
        to_inside = boundary > inside
        inside, boundary = max(inside, boundary), emit[k] + max(inside, boundary + close)
        back.append((to_inside, from_boundary))
    tags = [boundary > inside]
    for k in range(len(at) - 1, 0, -1):
        tags.append(back[k][1] if tags[-1] else back[k][0])
    return tags[::-1]


def token_key(word: str) -> int:
    """64 bits that stand for a token."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _short(word: str) -> int:
    bare = word.replace(".", "")
    return int(len(bare) <= 3 and not bare.isdigit())


class Tokens:
    """A code for each token seen: sorted keys, nine bytes a token."""

    def __init__(self, keys: Iterable[int] = (), codes: Iterable[int] = ()):
        keys, codes = np.asarray(keys, np.int64), np.asarray(codes, np.uint8)
        order = np.argsort(keys)
        self.keys, self.codes = keys[order], codes[order]
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def at(self, key: int) -> int:
        """The code of a key, -1 where there is none."""
        k = int(np.searchsorted(self.keys, key))
        return int(self.codes[k]) if k < len(self.keys) and self.keys[k] == key else -1

    def code(self, word: str) -> int:
        code = self.known.get(word)
        if code is None:
            if len(self.known) >= HELD:
                self.known.clear()
            code = self.known[word] = self.at(token_key(word))
        return code


class Tally:
    """What texts tell without labels: counts of tokens, of sure cases and of joins with a mark near them."""

    def __init__(self):
        self.ends: dict[str, list[int]] = {}  # token: before a mark that ends a block, before any mark, before a mark and a number
        self.begins: dict[str, list[int]] = {}  # token: begins a block or follows a strong mark outside quotations, follows another mark
        self.cases: Counter[tuple] = Counter()  # (what is known of a candidate, token before, token after)
        self.joins: Counter[tuple[str, int]] = Counter()  # (two blocks joined, where) that have another candidate near the join
        self.asks = 0  # blocks that the unmarked chain decides

    def __len__(self) -> int:
        return len(self.ends) + len(self.begins) + len(self.cases) + len(self.joins)

    def _end(self, word: str, final: int, to_number: int) -> None:
        n = self.ends.setdefault(word, [0, 0, 0])
        n[0] += final
        n[1] += 1
        n[2] += to_number

    def _begin(self, word: str, later: int) -> None:
        # only tokens with a capital, or without case, are asked for
        if word and unicodedata.category(word[0]) in ("Lu", "Lt", "Lo", "Lm"):
            self.begins.setdefault(word, [0, 0])[later] += 1

    def _case(self, c: Candidate, is_boundary: bool) -> None:
        before = c.before if c.asks_before() else ""
        after = c.after if c.asks_after() else ""
        number = "0" if c.before == "0" else "x"
        about = f"{c.mark} {c.kind} {c.gap} {c.inside:d} {c.closed:d} {number} {_short(before)} {is_boundary:d}"
        self.cases[about, before, after] += 1

    def add(self, text: str) -> None:
        """Count a text. Each block is joined to the next one, the last one to the first."""
        parts = []
        for a, b in blocks(text):
            p = text[a:b].strip(_WHITE)
            if not p or is_heading(text, a):
                continue
            parts.append(p)
            self._begin(_word_after(p, 0)[1], 0)
            if p[-1] in MARKS or p[-1] in CLOSERS and p[:-1].rstrip(_GAPS)[-1:] in MARKS:
                self._end(_word_before(p, len(p)), 1, 0)
            found = candidates(p)
            for c in found:
                if c.mark == "dot":
                    self._end(c.before, 0, c.kind == "digit" and c.gap != "none")
                self._begin(c.after, 0 if c.mark == "strong" and not c.inside and not c.closed and c.kind != "lower" else 1)
                # a lower-case continuation goes on
                if c.mark != "space" and (c.inside or c.kind == "lower" and c.mark != "strong"):
                    self._case(c, False)
            self.asks += asks_chain(found, text[a:b])
        for x, y in zip(parts, [*parts[1:], *parts[:1]]):
            thai = "฀" <= x[-1] <= "๿"
            if not thai and x[-1] not in MARKS:
                continue
            # joined blocks part at the join
            joined, cut = x[-60:] + " " + y[:60], len(x[-60:])
            found = candidates(joined)
            at = [c for c in found if c.at == cut]
            for c in at:
                if not c.inside and c.kind != "lower":
                    self._case(c, True)
            if at and x[-1] in MARKS and any(0 < abs(c.at - cut) < 3 for c in found):
                self.joins[joined, cut] += 1

    def rows(self) -> Iterator[tuple]:
        """All counts as ``(what, a, b, about, x, y, z)``."""
        for word, n in self.ends.items():
            yield "end", token_key(word), _short(word), None, *n
        for word, n in self.begins.items():
            yield "begin", token_key(word), None, None, *n, 0
        for (about, before, after), n in self.cases.items():
            yield "case", token_key(before) if before else None, token_key(after) if after else None, about, n, 0, 0
        for (joined, cut), n in self.joins.items():
            yield "join", cut, None, joined, n, 0, 0
        if self.asks:
            yield "asks", None, None, None, self.asks, 0, 0


def end_code(final: int, dotted: int, to_number: int, short: int) -> int:
    if final > 0.02 * dotted:
        return 0
    if dotted > 2 and to_number > 0.6 * dotted:
        return 1
    return 2 + 2 * min(dotted, MOST_SEEN) + short


def begin_code(first: int, later: int) -> int:
    return 0 if first > 0.01 * later else 1 + min(later, 5)


class BoundaryModel:
    """Weights of the chain and the tables behind two of its features."""

    # Where learning begins: marks end sentences, what is inside a quotation doesn't.
    START = {
        "strong": 3.0, "dots": 1.0, "dot": 1.5, "space": 4.0, "inside": -12.0, "closed&letter": -1.5,
        "lower": -9.0, "lower&strong": 3.0, "digit": -0.3, "mark": -2.0, "end": 0.0, "upper": 1.0, "opener": 1.0,
        "none&dot": -2.5, "none&dot&digit": -6.0, "before": 1.0, "after": 1.0, "number&dot": -1.0, "near": -4.0,
    }

    def __init__(self):
        self.weights = dict(self.START)
        self.ends = Tokens()
        self.begins = Tokens()
        self.rate = 0.25
        self.unmarked = UnmarkedModel()
        self.scores: dict[tuple, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"scores": {}}

    def end_value(self, code: int, short: int) -> float:
        """Evidence of a token before a mark by its code; -1 is an unseen one."""
        if code in (0, 1):
            return -5.0 if code else 1.5
        n, short = divmod(code - 2, 2) if code > 1 else (0, short)
        return max(-5.0, n * log(1 - self.rate) + (-1.5 if short and n < 3 else 0.0))

    @staticmethod
    def begin_value(code: int) -> float:
        return 0.0 if code < 0 else 2.0 if code == 0 else -0.5 * (code - 1)

    def before(self, word: str) -> float:
        """Evidence that a mark after this token ends a sentence."""
        return self.end_value(self.ends.code(word), _short(word)) if word else 0.0

    def after(self, word: str) -> float:
        """Evidence that this token begins a sentence."""
        return self.begin_value(self.begins.code(word)) if word else 0.0

    def features(self, c: Candidate, before: float | None = None, after: float | None = None) -> dict[str, float]:
        """Features of a candidate; the evidence of its tokens may be given."""
        out = {c.mark: 1.0, c.kind: 1.0}
        if c.mark == "space":
            return {"space": 1.0, "inside": float(c.inside)}
        if c.inside:
            out["inside"] = 1.0
        if c.closed and c.kind == "letter":
            out["closed&letter"] = 1.0
        if c.kind == "lower" and c.mark == "strong":
            out["lower&strong"] = 1.0
        if c.gap == "none" and c.mark == "dot":
            out["none&dot"] = 1.0
            if c.kind == "digit" and c.before == "0":
                out["none&dot&digit"] = 1.0
        if c.asks_before():
            out["before"] = self.before(c.before) if before is None else before
            if c.before == "0":
                out["number&dot"] = 1.0
        if c.asks_after():
            out["after"] = self.after(c.after) if after is None else after
        return out

    def score(self, features: dict[str, float]) -> float:
        w = self.weights
        return sum(w.get(k, 0.0) * v for k, v in features.items())

    def emissions(self, found: list[Candidate]) -> list[float]:
        """Scores of candidates; those that are alike in all that features look at are scored once."""
        out = []
        for c in found:
            before = c.before if c.asks_before() else "0" if c.before == "0" else ""
            about = c.mark, c.kind, c.gap, c.inside, c.closed, before, c.after if c.asks_after() else ""
            score = self.scores.get(about)
            if score is None:
                if len(self.scores) >= HELD:
                    self.scores.clear()
                score = self.scores[about] = self.score(self.features(c))
            out.append(score)
        return out

    def tag(self, found: list[Candidate]) -> list[bool]:
        """Which candidates of a block end a sentence."""
        return best_path([c.at for c in found], self.emissions(found), self.weights["near"])

    # -- learning ------------------------------------------------------------------
    def learn(self, texts: list[str]) -> BoundaryModel:
        """Learn from texts at hand, as ``train`` does from a table."""
        tally = Tally()
        for t in texts:
            tally.add(t)
        rows = list(tally.rows())
        ends = [(a, n[0], n[1], n[2], b) for what, a, b, _, *n in rows if what == "end"]
        begins = [(a, n[0], n[1]) for what, a, _, _, *n in rows if what == "begin"]
        self.ends = Tokens([e[0] for e in ends], [end_code(*e[1:]) for e in ends])
        self.begins = Tokens([e[0] for e in begins], [begin_code(*e[1:]) for e in begins])
        self.learn_rate(sum(e[1] for e in ends), sum(e[2] for e in ends))
        cases: Counter[tuple] = Counter()
        for what, a, b, about, n, *_ in rows:
            if what == "case":
                cases[about, None if a is None else self.ends.at(a), None if b is None else self.begins.at(b)] += n
        self.learn_weights([(*c, n) for c, n in cases.items()])
        limits = Counter()
        for (joined, cut), n in tally.joins.items():
            limits[self.join_limits(joined, cut)] += n
        self.learn_transition([(*c, n) for c, n in limits.items()])
        parts = [t[a:b].strip(_WHITE) for t in texts for a, b in blocks(t) if not is_heading(t, a)]
        self.unmarked.learn(self.unspaced_sentences([p for p in parts if p]))
        return self

    def learn_rate(self, ended: int, marks: int) -> None:
        self.rate = min(0.5, max(0.05, ended / marks)) if marks else 0.25

    def learn_weights(self, cases: list[tuple[str, int | None, int | None, int]], rounds: int = 2) -> None:
        """Averaged perceptron over ``(about, code before, code after, number)``.

        All cases come once a round, in ``SLICES`` parts of like make-up; equal ones of a
        part come in a row, whose updates follow without a step for each.
        """
        known: Counter[tuple] = Counter()
        for about, before, after, n in cases:
            mark, kind, gap, inside, closed, number, short, yes = about.split(" ")
            c = Candidate(0, mark, inside == "1", closed == "1", gap, number, kind, "")
            features = self.features(c, 0.0 if before is None else self.end_value(before, int(short)), 0.0 if after is None else self.begin_value(after))
            known[tuple(sorted(features.items())), yes == "1"] += n
        order = sorted(known.items())
        random = np.random.default_rng(3)
        lag: Counter[str] = Counter()
        steps = 0
        for k in range(rounds * SLICES):
            for i in random.permutation(len(order)).tolist():
                (items, is_boundary), n = order[i]
                n = n * (k + 1) // SLICES - n * k // SLICES
                score = self.score(dict(items))
                if n and (score > 0) != is_boundary:
                    gain = STEP * sum(v * v for _, v in items)
                    u = min(n, floor(-score / gain) + 1 if is_boundary else ceil(score / gain))
                    for name, v in items:
                        step = (STEP if is_boundary else -STEP) * v
                        self.weights[name] = self.weights.get(name, 0.0) + u * step
                        lag[name] += step * (u * steps + u * (u - 1) / 2)
                steps += n
        if steps >= 50:
            self.weights = {name: v - lag[name] / steps for name, v in self.weights.items()}

    def join_limits(self, joined: str, cut: int) -> tuple[int, int]:
        """From how many steps of the transition's weight on the join is found, and something near it as well."""
        found = candidates(joined)
        at, emit = [c.at for c in found], self.emissions(found)
        join = at.index(cut)
        near = [k for k, x in enumerate(at) if 0 < abs(x - cut) < 3]

        def path(step: int) -> list[bool]:
            return best_path(at, emit, self.START["near"] + STEP * step)

        def both(step: int) -> bool:
            tags = path(step)
            return tags[join] and any(tags[k] for k in near)

        steps = range(-MOST_STEPS, MOST_STEPS + 1)
        return bisect_left(steps, True, key=lambda s: path(s)[join]) - MOST_STEPS, bisect_left(steps, True, key=both) - MOST_STEPS

    def learn_transition(self, limits: list[tuple[int, int, int]]) -> None:
        """Weight of two boundaries with no room between them, from ``(join found from, both found from, number)``.

        A block's end is a boundary, what is near it within isn't. A perceptron over whole
        paths that sees each join once: the weight falls where the best path has both, and
        rises where it misses the join; it moves by the surplus of the one over the other.
        """
        left = float(sum(n for *_, n in limits))
        every, step, last = left, 0, 0
        while left > 0 and abs(step) < MOST_STEPS:
            surplus = sum(n * ((step < join) - (step >= both)) for join, both, n in limits)
            if not surplus or surplus * last < 0:
                break
            left -= every / abs(surplus)
            last = 1 if surplus > 0 else -1
            step += last
        self.weights["near"] = self.START["near"] + STEP * step

    def unspaced_sentences(self, parts: list[str]) -> list[list[str]]:
        """Sentences of the blocks of scripts without spaces, from which the unmarked chain learns; not of those that it decides."""
        out = []
        for p in parts:
            if len(UNSPACED.findall(p)) > 0.6 * len(p):
                found = candidates(p)
                if asks_chain(found, p):
                    continue
                cuts = [0, *(c.at for c, yes in zip(found, self.tag(found)) if yes), len(p)]
                out.append([p[a:b] for a, b in zip(cuts, cuts[1:])])
        return out

    def cuts(self, block: str) -> list[int]:
        """Ends of sentences within a block."""
        found = candidates(block)
        if self.unmarked.learned and asks_chain(found, block):
            return self.unmarked.cuts(block)[:-1]
        return [c.at for c, yes in zip(found, self.tag(found)) if yes]

    def split(self, text: str) -> Iterator[tuple[int, int]]:
        """Sentences of a text as code point spans, without white space at their ends."""
        for a, b in blocks(text):
            cuts = [a]
            if not is_heading(text, a):
                cuts += [a + c for c in self.cuts(text[a:b])]
            for x, y in zip(cuts, [*cuts[1:], b]):
                part = text[x:y]
                lead = len(part) - len(part.lstrip(_WHITE))
                size = len(part.strip(_WHITE))
                if size:
                    yield x + lead, x + lead + size


def _text_formats(documents: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("source_path", r"\.([^.]+)$", 1))
    return documents.where(ext.isin(*FORMATS) & F.col("content").isNotNull() & F.col("document_id").isNotNull())


def counted(documents: DataFrame) -> DataFrame:
    """What all texts tell without labels, as rows of ``Tally``; several of one key come from different tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["what", "a", "b", "about", "x", "y", "z"]

        def out(tally: Tally) -> pa.RecordBatch:
            columns = list(zip(*tally.rows())) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        tally = Tally()
        for batch in batches:
            for text in batch.column(0):
                tally.add(text.as_py())
                if len(tally) >= HELD:
                    yield out(tally)
                    tally = Tally()
        yield out(tally)

    return documents.select("content").mapInArrow(run, "what string, a long, b long, about string, x long, y long, z long")


def _codes(rows: DataFrame, code: Column) -> tuple[DataFrame, Tokens]:
    """``(a, code)`` of every token, as a table and at hand."""
    summed = rows.groupBy("a").agg(F.max("b").alias("b"), *(F.sum(c).alias(c) for c in "xyz"))
    codes = checkpoint(summed.select("a", code.cast("int").alias("code")))
    taken = codes.select("a", F.col("code").cast("smallint").alias("code")).toArrow()
    return codes, Tokens(taken["a"].to_numpy(), taken["code"].to_numpy())


def train(documents: DataFrame) -> BoundaryModel:
    """Learn from all documents: one pass that counts, and one for the unmarked chain where some block asks for it."""
    spark = documents.sparkSession
    ship(spark)
    model = BoundaryModel()
    rows = checkpoint(counted(documents))
    total = {r["what"]: r for r in rows.groupBy("what").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    x, y, z, seen = F.col("x"), F.col("y"), F.col("z"), F.lit(MOST_SEEN)
    end = F.when(x > 0.02 * y, 0).when((y > 2) & (z > 0.6 * y), 1).otherwise(2 + 2 * F.least(y, seen) + F.col("b"))
    ends, model.ends = _codes(rows.where("what = 'end'"), end)
    begins, model.begins = _codes(rows.where("what = 'begin'"), F.when(x > 0.01 * y, 0).otherwise(1 + F.least(y, F.lit(5))))
    if "end" in total:
        model.learn_rate(total["end"]["x"], total["end"]["y"])
    if "case" in total:
        cases = rows.where("what = 'case'").groupBy("a", "b", "about").agg(F.sum("x").alias("n"))
        cases = cases.join(ends.select("a", F.col("code").alias("before")), "a", "left")
        cases = cases.join(begins.select(F.col("a").alias("b"), F.col("code").alias("after")), "b", "left")
        # a token that stands in no table has the code -1
        before, after = (F.when(F.col(k).isNotNull(), F.coalesce(c, F.lit(-1))).alias(c) for k, c in (("a", "before"), ("b", "after")))
        cases = cases.groupBy("about", before, after).agg(F.sum("n").alias("n"))
        model.learn_weights([tuple(r) for r in cases.select("about", "before", "after", "n").collect()])
    if "join" in total:
        model.learn_transition(_join_limits(rows.where("what = 'join'"), model))
    if "asks" in total:
        model.unmarked = unmarked.train(_unspaced_items(documents, model))
    return model


def _join_limits(joins: DataFrame, model: BoundaryModel) -> list[tuple[int, int, int]]:
    frozen = joins.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [frozen.value.join_limits(joined, cut) for joined, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = [pa.array([p[k] for p in pairs], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], ["join", "both", "n"])

    distinct = joins.groupBy("about", "a").agg(F.sum("x").alias("n"))
    limits = distinct.mapInArrow(run, "join int, both int, n long").groupBy("join", "both").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in limits.orderBy("join", "both").collect()]


def _unspaced_items(documents: DataFrame, model: BoundaryModel) -> DataFrame:
    """``(document_id, item_no, text, ends)``: what the unmarked chain learns from, of every document."""
    frozen = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32())]
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                out: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    parts = [text[a:b].strip(_WHITE) for a, b in blocks(text) if not is_heading(text, a)]
                    known = frozen.value.unspaced_sentences([p for p in parts if p])
                    out += [(key, k, plain, ends) for k, (plain, ends) in enumerate(unmarked.items(known))]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["document_id", "item_no", "text", "ends"])

    return documents.select("document_id", "content").mapInArrow(run, "document_id string, item_no int, text string, ends array<int>")


def sentences(documents: DataFrame, model: BoundaryModel) -> DataFrame:
    """``(document_id, sentence_no, start_char_offset, end_char_offset, text)``, offsets in UTF-16 units.

    Null, empty and blank contents have no sentences. Repeated rows of documents repeat theirs.
    """
    spark = documents.sparkSession
    ship(spark)
    frozen = spark.sparkContext.broadcast(model)  # nine bytes a token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = ["document_id", "sentence_no", "start_char_offset", "end_char_offset", "text"]
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                out: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tree = Tree(text)
                    out += [(key, k, tree.unit(a), tree.unit(b), text[a:b]) for k, (a, b) in enumerate(model.split(text))]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = documents.select("document_id", "content")
    return rows.mapInArrow(run, "document_id string, sentence_no int, start_char_offset int, end_char_offset int, text string")


def document_sentences(loaded: DataFrame) -> DataFrame:
    """Sentences of the current .md, .docx and .txt documents."""
    documents = _text_formats(current_documents(loaded))
    return sentences(documents, train(documents))
