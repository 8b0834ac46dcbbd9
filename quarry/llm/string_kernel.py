"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

A text is a bag of units: its lower-cased words, stripped of outer marks, and also without inner ones; the joins of
neighbouring fragments of at most two characters, alone and with what stands beside them ("m oron", "i d i o t"); and the
joins of two neighbouring words, without marks, of at most WIDTH letters in all ("stu pid").  Units longer than WIDTH are
cut into overlapping windows.  The kernel counts common subsequences of ORDER letters, each weighted by DECAY to the power
of what it spans in both strings, so that inserted or dropped characters cost a factor and not the match.  Kernel values
against the landmarks, whitened, are the features of a unit; the machine is trained on witnesses (the most telling unit of
each labelled text, found anew after a first fit, as labels stand on texts); a text scores its highest unit, or FLOOR where
none is above it, calibrated.

So units that can't be above FLOOR needn't be valued.  Sums over the threes of a unit bound its value (see Bound); for a join
of two words they fall into the sums of each and products of a vector of the one with a vector of the other.  Whatever the
bound leaves is valued by the kernel; no unit is lost.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_batches, table
from quarry.llm.training import held_out, labelled

ORDER, DECAY, WIDTH = 3, 0.6, 16
#: Share of the letter pairs of some insult, each with at most GAP characters between, that the clean units first given to
#: the machine hold.  Chooses training units only; every unit of a text is valued by the kernel.
MIN_PAIRS, GAP = 0.75, 2
#: Weight of a made-up variant against a labelled text when values become probabilities.
VARIANT_WEIGHT = 0.1
#: Units whose value a worker keeps (a cache only), and characters of text worked on at once.
CACHE, CHUNK = 600_000, 4_000_000
#: Strings bounded at once, joins bounded at once, and strings valued at once.
BLOCK, JOINS, LOT = 16_384, 1_024, 2_048
#: Letters that have at most this share of a bound's weight are bounded together, in CLASSES classes.
RARE, CLASSES = 0.06, 3
#: Joins of two words are valued in turns, up to these ranks in some text by their bound.
TURNS = (2, 8, 32)
#: What makes a unit an insult: its share among toxic texts, against that among clean ones in standard errors and as log
#: odds (copied texts bring chance company, which is rarer).
MIN_SHARE, MIN_Z, MIN_ODDS = 0.01, 5.0, 2.0
_known: dict[str, dict[str, float]] = {}
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_BACKGROUND = -1e9
#: Values below this count as it; the machine's margin, below which the fit looks for no hard units.
FLOOR, MARGIN = -0.5, -1.0


def split(text: str) -> list[str]:
    return text.lower().replace(", ", " ").replace(". ", " ").split()  # outer marks go anyway


def fragment_joins(words: list[str]) -> set[str]:
    """The joins of fragments of a whole text, but for those of two words within WIDTH, which all pairs have."""
    out: set[str] = set()
    end = -1
    for k in [k for k, n in enumerate(map(len, words)) if n <= 2]:
        if k > end:  # a run of fragments begins
            end = k
            while end + 1 < len(words) and len(words[end + 1]) <= 2:
                end += 1
            if k and (end > k or len(words[k - 1]) + 2 > WIDTH):
                out.update([words[k - 1] + join for join in itertools.accumulate(words[k : min(end + 1, k + WIDTH)])])
        if end > k or end + 1 < len(words) and len(words[end + 1]) + 2 > WIDTH:
            joins = list(itertools.accumulate(words[k : min(end + 1, k + WIDTH)]))  # the first fragment with those that follow
            out.update(joins[1:])
            if end + 1 < len(words) and end < k + WIDTH:
                out.add(joins[-1] + words[end + 1])
    return out


def cleaned(raw: str) -> tuple[str, ...]:
    """The units of a word: without outer marks, and also without marks put between its letters."""
    if raw.isalpha():
        return (raw,) if len(raw) >= ORDER else ()
    outer = _OUTER.sub("", raw)
    inner = outer if outer.isalpha() else _INNER.sub("", outer)
    return tuple(u for u in ((outer, inner) if inner != outer else (outer,)) if len(u) >= ORDER)


def letters(raw: str) -> str:
    return raw if raw.isalpha() else _INNER.sub("", raw)


def units(text: str, pairs: bool = True) -> set[str]:
    """The distinct units of a whole text."""
    words = split(text)
    out = {u for raw in fragment_joins(words).union(words) for u in cleaned(raw)}
    if pairs:
        plain = [x for x in map(letters, words) if x]
        out.update([a + b for a, b in zip(plain, plain[1:]) if ORDER <= len(a) + len(b) <= WIDTH])
    return out


def gapped(unit: str) -> list[str]:
    """Variants with a foreign or repeated character inside, one at a time."""
    return [unit[:p] + c + unit[p:] for p in (1, len(unit) // 2, len(unit) - 1) for c in ("x", unit[p])] if len(unit) > 3 else []


def windows(unit: str) -> list[str]:
    if len(unit) <= WIDTH:
        return [unit]
    return [unit[a : a + WIDTH] for a in range(0, len(unit) - WIDTH // 2, WIDTH // 2)]


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.int32)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    return out


def kernel(s: list[str], t: list[str], paired: bool = False) -> np.ndarray:
    """Subsequence kernel of order ORDER between all of s and all of t (or s[k] and t[k]), not normalised."""
    if not s or not t:
        return np.zeros(len(s) if paired else (len(s), len(t)), np.float32)
    order = sorted(range(len(s)), key=lambda k: -len(s[k]))
    if order != list(range(len(s))):
        out = kernel([s[k] for k in order], [t[k] for k in order] if paired else t, paired)
        back = np.empty(len(s), np.int64)
        back[order] = np.arange(len(s))
        return out[back]
    a = _codes(s, max(map(len, s)))
    b = _codes(t, max(map(len, t)))
    b = np.where(b == 0, -1, b).T[:, :, None] if paired else np.where(b == 0, -1, b).T[:, None, :]
    shape = (b.shape[0], len(s), 1 if paired else len(t))  # places of t come first: each step works on whole planes
    live = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]  # K'_1 .. K'_{n-1} at each prefix of t
    total = np.zeros(shape[1:], np.float32)
    lam, lam2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    for i in range(a.shape[1]):
        n = int((a[:, i] != 0).sum())  # strings come sorted by length, the longest first
        if not n:
            break
        hit = (a[None, :n, i, None] == (b[:, :n] if paired else b)).astype(np.float32) * lam2
        total[:n] += (hit[1:] * live[-1][:-1, :n]).sum(0)
        for p in range(ORDER - 2, -1, -1):
            run = np.zeros((n, shape[2]), np.float32)
            for j in range(shape[0]):
                run *= lam
                if p == 0:
                    run += hit[j]
                elif j:
                    run += hit[j] * live[p - 1][j - 1, :n]
                cell = live[p][j, :n]
                cell *= lam
                cell += run
    return total[:, 0] if paired else total


def prefix_kernel(s: list[str], t: list[str]) -> np.ndarray:
    """kernel(s, t) for many strings s: each distinct prefix is worked on once, and only at the places of t that hold its
    last letter.  Weights are kept divided by DECAY to the power of the place, so that nothing decays in between."""
    assert ORDER == 3
    out = np.zeros((len(s), len(t)), np.float32)
    order = np.array(sorted(range(len(s)), key=s.__getitem__), np.int64)
    if not len(s) or not t:
        return out
    a = _codes([s[k] for k in order], max(map(len, s)))
    owner = np.repeat(np.arange(len(t)), [len(x) for x in t])
    at = np.concatenate([np.arange(len(x)) for x in t])
    letter = np.frombuffer("".join(t).encode("utf-32-le"), np.uint32).astype(np.int32)
    steps = {}
    for c in np.unique(letter).tolist():
        h = np.flatnonzero(letter == c)
        later = ((owner[h, None] == owner[None, :]) & (at[h, None] < at[None, :])).astype(np.float32)
        ends = np.zeros((len(h), len(t)), np.float32)
        ends[np.arange(len(h)), owner[h]] = DECAY ** (at[h] + 2.0)
        steps[c] = h, later, ends, (DECAY ** -at[h].astype(float) @ later).astype(np.float32)
    one = two = np.zeros((1, len(letter)), np.float32)  # sums over earlier places, of one and of two letters
    total = np.zeros((1, len(t)), np.float32)
    node = np.zeros(len(s), np.int64)
    live = np.arange(len(s))
    for i in range(a.shape[1]):
        live = live[a[live, i] != 0]
        rows = a[live, : i + 1]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(1)
        first = live[fresh]
        by = np.argsort(a[first, i], kind="stable")
        parent, last = node[first[by]], a[first[by], i]
        rank = np.empty(len(first), np.int64)
        rank[by] = np.arange(len(first))
        node[live] = rank[np.cumsum(fresh) - 1]
        one, two, total = one[parent], two[parent], total[parent]
        cuts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1, [len(last)]])
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x < y and (step := steps.get(int(last[x]))):
                h, later, ends, starts = step
                total[x:y] += two[x:y, h] @ (ends * np.float32(DECAY**i))
                two[x:y] += one[x:y, h] @ later
                one[x:y] += starts * np.float32(DECAY**-i)
        done = live if i + 1 == a.shape[1] else live[a[live, i + 1] == 0]
        out[order[done]] = total[node[done]]
    return out


def squared_norms(s: list[str]) -> np.ndarray:
    return np.concatenate([kernel(part, part, paired=True) for at in range(0, len(s), LOT) for part in [s[at : at + LOT]]] or [np.zeros(0, np.float32)])


def normalised(s: list[str], t: list[str], norm_t: np.ndarray, norm_s: np.ndarray | None = None) -> np.ndarray:
    """Mean of the normalised kernel and its fourth power: both near misses and exact matches stand out."""
    out = np.empty((len(s), len(t)), np.float32)
    own = squared_norms(s) if norm_s is None else norm_s
    for at in range(0, len(s), LOT):
        part = s[at : at + LOT]
        k = prefix_kernel(part, t) / np.sqrt(np.maximum(own[at : at + LOT], 1e-12)[:, None] * norm_t[None, :])
        out[at : at + len(part)] = (k + k * k * k * k) / 2
    return out


def spread(strings: list[str], n: int) -> list[str]:
    """The first string and then, n in all, always the one least alike any chosen before."""
    if len(strings) <= n:
        return list(strings)
    norms = kernel(strings, strings, paired=True)
    alike = normalised(strings, strings, norms)
    chosen, near = [0], alike[0].copy()
    while len(chosen) < n:
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, alike[chosen[-1]])
    return [strings[k] for k in chosen]


def holds_pairs(strings: list[str], marks: list[str]) -> np.ndarray:
    """Which strings hold at least MIN_PAIRS of the neighbouring letter pairs of some mark, in order and with at most GAP
    characters between the two letters."""
    near = np.zeros(len(strings), bool)
    if not strings or not marks:
        return near
    letters = sorted(set("".join(marks)))
    code = {c: k + 1 for k, c in enumerate(letters)}
    size = len(letters) + 1
    table_of = np.zeros(0x110000, np.int16)
    for c, k in code.items():
        table_of[ord(c)] = k
    bit: dict[str, int] = {}
    for m in marks:  # neighbours of one mark get bits side by side
        for k in range(len(m) - 1):
            bit.setdefault(m[k : k + 2], len(bit))
    tables = [np.zeros(size * size, np.uint64) for _ in range(len(bit) // 64 + 1)]
    for p, k in bit.items():
        tables[k // 64][code[p[0]] * size + code[p[1]]] |= np.uint64(1) << np.uint64(k % 64)
    wanted = []
    for m in marks:
        own: dict[int, int] = {}
        for k in {bit[m[k : k + 2]] for k in range(len(m) - 1)}:
            own[k // 64] = own.get(k // 64, 0) | 1 << (k % 64)
        wanted.append(([(w, np.uint64(v)) for w, v in own.items()], int(np.ceil(MIN_PAIRS * sum(v.bit_count() for v in own.values())))))
    for at in range(0, len(strings), 50_000):
        some = strings[at : at + 50_000]
        flat = table_of[np.frombuffer("".join([s + "\n" * (GAP + 1) for s in some]).encode("utf-32-le"), np.uint32)].astype(np.int32)
        begins = np.concatenate([[0], np.cumsum([len(s) + GAP + 1 for s in some])[:-1]])
        cells = [flat[:-gap] * size + flat[gap:] for gap in range(1, GAP + 2) if len(flat) > gap]
        held = []
        for t in tables:
            total = np.zeros(len(flat), np.uint64)
            for gap, cell in enumerate(cells, 1):
                total[:-gap] |= t[cell]
            held.append(np.bitwise_or.reduceat(total, begins))
        ok = near[at : at + 50_000]
        for parts, need in wanted:
            found = np.bitwise_count(held[parts[0][0]] & parts[0][1])
            for w, v in parts[1:]:
                found = found + np.bitwise_count(held[w] & v)
            ok |= found >= need
    return near


class Bound:
    """Upper bounds of a machine's values, for many units at once.  Letters of little weight share classes, and a three of
    classes has the largest weight of its letters' threes.

    A unit's value is bias + (sum of w k + sum of w k**4) / 2.  Three sums over its threes bound it: that of w k over all
    landmarks, that over those with w > 0, and one that no single k exceeds (the largest weight of each three among the
    landmarks).  They are divided by the norm of a unit of that length without repeated subsequences, the least there is; and
    for what is left then, by its own."""

    def __init__(self, model: "KernelModel"):
        found = sorted(set("".join(model.landmarks)))
        s = len(found) + 1
        self.code = np.zeros(0x110000, np.int16)
        self.code[[ord(c) for c in found]] = np.arange(1, s)
        single = np.zeros((3, s, s, s))  # all weights, those above zero, the largest of one landmark
        for t, w, norm in zip(model.landmarks, model.weights, model.norms):
            own = np.zeros((s, s, s))
            c = self.code[[ord(x) for x in t]]
            for p in itertools.combinations(range(len(t)), ORDER):
                own[tuple(c[list(p)])] += DECAY ** (p[-1] - p[0] + 1) / np.sqrt(norm)
            single[0] += w * own
            single[1] += max(w, 0) * own
            single[2] = np.maximum(single[2], own)
        share = single[1].sum((1, 2)) + single[1].sum((0, 2)) + single[1].sum((0, 1))
        by = np.argsort(share[1:], kind="stable") + 1
        rare = int((np.cumsum(share[by]) <= RARE * share.sum()).sum())
        group = np.zeros(s, np.int64)
        group[by[:rare]] = 1 + np.arange(rare) * CLASSES // max(rare, 1)
        group[np.sort(by[rare:])] = group.max() + 1 + np.arange(s - 1 - rare)
        self.size = s = len(np.unique(group))
        group = np.unique(group, return_inverse=True)[1]  # fewer rare letters than classes leave numbers free
        self.code = group[self.code].astype(np.int16)
        three = np.full((3, s, s, s), -np.inf)
        np.maximum.at(three, (slice(None), group[:, None, None], group[None, :, None], group[None, None, :]), single)
        self.last = np.ascontiguousarray(three.transpose(2, 1, 0, 3).reshape(s, s, 3 * s), np.float32)  # [second][first, third]
        self.first = np.ascontiguousarray(three.transpose(3, 2, 0, 1).reshape(s, s, 3 * s), np.float32)  # [third][second, first]
        self.bias = model.bias
        # squared norm of n letters whose subsequences differ: each counts with the square of its weight
        spans = [sum((n - d) * (d - 1) * DECAY ** (2 * d + 2) for d in range(2, n)) for n in range(WIDTH + 1)]
        self.norm = np.sqrt(np.maximum(spans, 1e-12)).astype(np.float32)

    def parts(self, strings: list[str], sides: bool) -> tuple[np.ndarray, ...]:
        """For strings of at most WIDTH letters: the three sums of each; and, with sides, what each brings into joins: its
        letters and its pairs on the left, its pairs and its letters on the right."""
        n, s = len(strings), self.size
        sizes = np.fromiter(map(len, strings), np.int64, n)
        codes = np.zeros((n, WIDTH), np.int8 if s < 128 else np.int32)
        codes[np.arange(WIDTH)[None, :] < sizes[:, None]] = self.code[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)]
        order = np.lexsort(codes.T[::-1])
        out = [np.zeros((n, w), np.float32) for w in ((3, s, 3 * s, 3 * s, s) if sides else (3,))]
        for at in range(0, n, BLOCK):
            some = order[at : at + BLOCK]
            self._block(codes[some], sizes[some], some, out)
        return tuple(x.reshape(n, 3, s) if x.shape[1] == 3 * s else x for x in out)

    def _block(self, codes: np.ndarray, sizes: np.ndarray, home: np.ndarray, out: list[np.ndarray]) -> None:
        """parts() of strings sorted by their codes: each distinct prefix is worked on once."""
        s, sides = self.size, len(out) > 1
        total, one, two = np.zeros((1, 3), np.float32), np.zeros((1, s), np.float32), np.zeros((1, 3 * s), np.float32)
        back, ahead, seen = two, one, one  # one and two are divided by DECAY to the place of their last letter
        node, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for m in range(WIDTH + 1):
            done = live[sizes[live] == m]
            if len(done):
                at, fall = node[done], np.float32(DECAY**m)
                for whole, part in zip(out, (total[at], one[at] * fall, two[at] * fall, back[at], ahead[at]) if sides else (total[at],)):
                    whole[home[done]] = part
            live = live[sizes[live] > m]
            if not len(live):
                return
            rows = codes[live, : m + 1]
            fresh = np.ones(len(live), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(1)
            first = live[fresh]
            by = np.argsort(codes[first, m], kind="stable")
            parent, last = node[first[by]], codes[first[by], m]
            rank = np.empty(len(first), np.int64)
            rank[by] = np.arange(len(first))
            node[live] = rank[np.cumsum(fresh) - 1]
            total, one, two = total.take(parent, 0), one.take(parent, 0), two.take(parent, 0)
            if sides:
                back, ahead, seen = back.take(parent, 0), ahead.take(parent, 0), seen.take(parent, 0)
            gain = np.float32(DECAY ** (m + 1))
            cuts = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1, [len(last)]])
            for x, y in zip(cuts[:-1], cuts[1:]):
                if c := int(last[x]):  # no other letter counts
                    total[x:y] += two[x:y, c::s] * gain
                    two[x:y] += one[x:y] @ self.last[c]
                    one[x:y, c] += np.float32(DECAY**-m)
                    if sides:
                        back[x:y] += (seen[x:y] @ self.first[c]) * gain
                        ahead[x:y, c] += gain
                        seen[x:y, c] += 1

    def may_pass(self, total: np.ndarray, sizes: np.ndarray | None, floor: float | np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether units with these sums, and sizes or squared norms, may have a value above floor (with room for rounding)."""
        return self.highest(total, sizes, own) > 2 * (floor - self.bias) * 0.999 - 1e-3

    def highest(self, total: np.ndarray, sizes: np.ndarray | None, own: np.ndarray | None = None) -> np.ndarray:
        """What units with these sums have at most of twice their value without bias."""
        every, plus, most = (total / (self.norm[sizes] if own is None else np.sqrt(np.maximum(own, 1e-12)))[:, None]).T
        return np.maximum(every, 0) + np.minimum(most * 1.001, 1) ** 3 * plus


@dataclass
class KernelModel:
    landmarks: list[str]
    norms: np.ndarray
    insults: list[str]
    weights: np.ndarray  # of kernel values: whitening and machine in one
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def values(self, strings: list[str]) -> np.ndarray:
        """The machine's value of each unit, that of its highest window."""
        return self._highest(strings, None, _BACKGROUND)

    def _highest(self, strings: list[str], bound: Bound | None, floor: float, total: np.ndarray | None = None, need: np.ndarray | None = None) -> np.ndarray:
        """Values of units; with a bound, only of those that may be above floor, and floor for the others.  ``total``: the
        bound's sums, for units of at most WIDTH letters that it has left at their length.  ``need``, with it: what a unit
        has to reach, floor or more; those that can't but may be above floor aren't valued and get minus infinity."""
        out = np.full(len(strings), floor, np.float64)
        pieces = [(w, k) for k, u in enumerate(strings) for w in windows(u)]
        texts, owner = [w for w, _ in pieces], np.array([k for _, k in pieces], np.int64)
        if bound and texts:
            left = np.arange(len(texts))
            if total is None:
                total = bound.parts(texts, False)[0]
                left = np.flatnonzero(bound.may_pass(total, np.array([len(w) for w in texts]), floor))
            own = squared_norms([texts[k] for k in left])
            ok = bound.may_pass(total[left], None, floor, own)
            if need is not None:
                enough = bound.may_pass(total[left], None, need[left], own)
                out[left[ok & ~enough]] = -np.inf
                ok &= enough
            left, own = left[ok], own[ok]
            texts, owner = [texts[k] for k in left], owner[left]
        else:
            own = squared_norms(texts)
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)  # neighbours share prefixes
        texts, owner, own = [texts[k] for k in order], owner[order], own[order]
        for at in range(0, len(texts), 65536):
            some = slice(at, at + 65536)
            got = normalised(texts[some], self.landmarks, self.norms, own[some]) @ self.weights + self.bias
            np.maximum.at(out, owner[some], got)
        return out

    def _valued(self, strings: list[str], bound: Bound | None, floor: float, known: dict[str, float], total: np.ndarray | None = None, need: np.ndarray | None = None) -> np.ndarray:
        """Values of units, from what is known or else as _highest gives them."""
        new: dict[str, int] = {}
        for k, u in enumerate(strings):
            if u not in known and new.setdefault(u, k) != k and need is not None:
                need[new[u]] = min(need[new[u]], need[k])
        if new:
            at = list(new.values())
            got = self._highest(list(new), bound, floor, None if total is None else total[at], None if need is None else need[at])
            known.update((u, v) for u, v in zip(new, got.tolist()) if v > -np.inf)
        return np.array([known.get(u, -np.inf) for u in strings], np.float64)

    def best(self, texts: list[str], known: dict[str, float], bound: Bound, floor: float = FLOOR) -> list[tuple[float, str]]:
        """Value and unit of the highest unit of each text (ties: the smaller unit), or floor and no unit where none is above
        it.  ``known`` keeps values of units between calls."""
        out: list[tuple[float, str]] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > CHUNK:
                out += self._best(held, known, bound, floor)
                held, size = [], 0
        return out + self._best(held, known, bound, floor) if held else out

    @staticmethod
    def _runs(ids: np.ndarray, text: np.ndarray, sizes: np.ndarray, raws: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of fragments that have joins other than those of two words within WIDTH: first and last place, whether the
        text has a word before and after, and whether it is of two, without marks, as are the words beside it, and all its
        joins are within WIDTH."""
        size = raws[ids]
        bits = size <= 2
        on = np.zeros(len(ids) + 1, bool)  # whether a run goes on from one place to the next
        on[1:-1] = bits[1:] & bits[:-1] & (text[1:] == text[:-1])
        begin, end = np.flatnonzero(bits & ~on[:-1]), np.flatnonzero(bits & ~on[1:])
        before, after = np.maximum(begin - 1, 0), np.minimum(end + 1, len(ids) - 1)
        left, right = (before < begin) & (text[before] == text[begin]), (after > end) & (text[after] == text[end])
        wide = np.maximum(np.where(left, size[before], 0), np.where(right, size[after], 0))
        clean = (sizes == raws)[ids]
        simple = (end == begin + 1) & (wide + 4 <= WIDTH) & clean[begin] & clean[end] & (clean[before] | ~left) & (clean[after] | ~right)
        use = (end > begin) | (wide + 2 > WIDTH)
        return begin[use], end[use], left[use], right[use], simple[use]

    def _best(self, texts: list[str], known: dict[str, float], bound: Bound, floor: float) -> list[tuple[float, str]]:
        bags = [split(t) for t in texts]
        found: list[tuple[int, float, str]] = []  # text, value, unit above floor
        best = np.full(len(texts), floor, np.float64)  # what each text's units found so far reach

        def note(owners: np.ndarray, value: np.ndarray, unit: Callable[[int], str]) -> None:
            np.maximum.at(best, owners, value)
            found.extend((int(owners[k]), float(value[k]), unit(k)) for k in np.flatnonzero(value == best[owners]).tolist())

        flat = list(itertools.chain.from_iterable(bags))
        number: dict[str, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        words = list(number)
        text = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        del bags
        plain = [w if w.isalpha() else _INNER.sub("", w) for w in words]
        sizes, raws = (np.fromiter(map(len, x), np.int64, len(x)) for x in (plain, words))
        # joins of fragments: of two without marks, and with a word beside them, they are joins of two; others go one by one
        begin, end, left, right, simple = self._runs(ids, text, sizes, raws)
        seen: dict[str, int] = defaultdict(itertools.count().__next__)
        owners, places = [], []
        for k in np.flatnonzero(~simple).tolist():
            for raw in fragment_joins(flat[begin[k] - left[k] : end[k] + 1 + right[k]]):
                for u in cleaned(raw):
                    owners.append(begin[k])
                    places.append(seen[u])
        del flat
        value = self._valued(list(seen), bound, floor, known)
        if (value > floor).any():
            strings, owners, places = list(seen), np.array(owners, np.int64), np.array(places, np.int64)
            use = np.flatnonzero(value[places] > floor)
            owners, places = text[owners[use]], places[use]
            note(owners, value[places], lambda k: strings[places[k]])
        begin, left, right = begin[simple], left[simple], right[simple]
        twos, two_of = np.unique(ids[begin] * len(words) + ids[begin + 1], return_inverse=True) if len(begin) else (begin, begin)
        two_of = two_of + len(words)
        plain += [plain[k // len(words)] + plain[k % len(words)] for k in twos.tolist()]
        sizes = np.concatenate([sizes, np.fromiter(map(len, plain[len(words) :]), np.int64, len(twos))])
        short = np.flatnonzero((sizes > 0) & (sizes <= WIDTH))
        row = np.zeros(len(plain), np.int64)
        row[short] = np.arange(len(short))
        total, one, two, back, ahead = bound.parts([plain[k] for k in short.tolist()], True)
        likely = short[bound.may_pass(total, sizes[short], floor) & (sizes[short] >= ORDER) & (short < len(words))].tolist()
        marked = np.flatnonzero((sizes[: len(words)] > WIDTH) | (sizes[: len(words)] < raws)).tolist()
        variants = [(k, u) for k in marked for u in cleaned(words[k]) if len(u) > WIDTH or u != plain[k]]
        value = np.concatenate([self._valued([u for _, u in variants], bound, floor, known), self._valued([plain[k] for k in likely], bound, floor, known, total[row[likely]])])
        variants += [(k, plain[k]) for k in likely]
        telling: dict[int, tuple[float, str]] = {}  # the highest unit of a word, less its value first
        for k in np.flatnonzero(value > floor).tolist():
            telling[variants[k][0]] = min(telling.get(variants[k][0], (0.0 - floor, "")), (-float(value[k]), variants[k][1]))
        if telling:
            of_word = np.full(len(plain), floor)
            of_word[list(telling)] = [-v for v, _ in telling.values()]
            p = np.flatnonzero(of_word[ids] > floor)
            note(text[p], of_word[ids[p]], lambda k: telling[int(ids[p[k]])][1])
        # joins of two neighbours, each different one once
        p = np.flatnonzero(sizes[ids] > 0)
        p, after = p[:-1], p[1:]
        both = sizes[ids[p]] + sizes[ids[after]]
        ok = (text[p] == text[after]) & (both >= ORDER) & (both <= WIDTH)
        place = np.concatenate([p[ok], begin[left], begin[right]])
        a = np.concatenate([ids[p[ok]], ids[begin[left] - 1], two_of[right]])
        b = np.concatenate([ids[after[ok]], two_of[left], ids[begin[right] + 2]])
        key = a * len(plain) + b
        pairs = np.sort(key)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        kept, sums_of = [pairs[:0]], [np.zeros((0, 3), np.float32)]
        for at in range(0, len(pairs), JOINS):
            i, j = np.divmod(pairs[at : at + JOINS], len(plain))
            x, y = row[i], row[j]
            sums = total.take(x, 0) + total.take(y, 0) + np.einsum("nij,nj->ni", back.take(y, 0), one.take(x, 0)) + np.einsum("nij,nj->ni", two.take(x, 0), ahead.take(y, 0))
            use = np.flatnonzero(bound.may_pass(sums, sizes[i] + sizes[j], floor))
            kept.append(pairs[at + use])
            sums_of.append(sums[use])
        del total, one, two, back, ahead
        kept, sums = np.concatenate(kept), np.concatenate(sums_of)
        if len(kept):
            i, j = np.divmod(kept, len(plain))
            both = sizes[i] + sizes[j]
            hit = np.zeros((2, len(plain)), bool)
            hit[0, i] = hit[1, j] = True
            at = np.flatnonzero(hit[0, a] & hit[1, b])
            pair = np.searchsorted(kept, key[at])
            ok = kept[np.minimum(pair, len(kept) - 1)] == key[at]
            pair, owners = pair[ok], text[place[at[ok]]]
            # the likeliest of each text first: others need only be valued if they may reach what those do
            order = np.lexsort((-bound.highest(sums, both)[pair], owners))
            pair, owners = pair[order], owners[order]
            rank = np.full(len(kept), len(pair))
            np.minimum.at(rank, pair, np.arange(len(pair)) - np.searchsorted(owners, owners))
            for low, high in itertools.pairwise((0, *TURNS, len(pair) + 1)):
                need = np.full(len(kept), np.inf)
                np.minimum.at(need, pair, best[owners])
                some = np.flatnonzero((rank >= low) & (rank < high))
                some = some[bound.may_pass(sums[some], both[some], need[some])]
                value = np.full(len(kept), -np.inf)
                value[some] = self._valued([plain[x] + plain[y] for x, y in zip(i[some].tolist(), j[some].tolist())], bound, floor, known, sums[some], need[some])
                use = np.flatnonzero(value[pair] > floor)
                note(owners[use], value[pair[use]], lambda k: plain[i[pair[use[k]]]] + plain[j[pair[use[k]]]])
        if len(known) > CACHE:
            known.clear()
        out = [(floor, "")] * len(texts)
        for k, v, u in found:
            if (-v, u) < (-out[k][0], out[k][1]):
                out[k] = (v, u)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(value, FLOOR) + self.offset, -35, 35)))


def fit_machine(landmarks: list[str], insults: list[str], x: list[str], y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 60) -> KernelModel:
    """Linear machine with squared hinge loss on whitened landmark kernels, by Newton steps; both classes weigh the same."""
    norms = kernel(landmarks, landmarks, paired=True)
    among = normalised(landmarks, landmarks, norms).astype(float)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    white = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    phi = np.column_stack([normalised(x, landmarks, norms) @ white, np.ones(len(x))])
    w8 = np.where(y > 0, weight / max(weight[y > 0].sum(), 1e-9), weight / max(weight[y <= 0].sum(), 1e-9)) * 1000
    w = np.zeros(phi.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (phi @ w) < 1
        a = phi[active] * w8[active, None]
        new = np.linalg.solve(a.T @ phi[active] + penalty, a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return KernelModel(landmarks, norms, insults, white @ w[:-1], float(w[-1]))


def _logistic(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted one-variable logistic fit with a weak prior."""
    x = np.column_stack([np.maximum(v, FLOOR), np.ones(len(v))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-2, x.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's three-word shingles, the same for most near copies."""
    for batch in batches:
        low = []
        for text in batch.column(0).fill_null("").to_pylist():
            w = text.lower().split()
            low.append(min((zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64())], names=["t", "y", "h"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, max_insults: int = 128, max_landmarks: int = 40, max_units: int = 4000, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> KernelModel | float:
    """Fit on at most max_train_rows labelled documents outside the held-out fold.

    The driver gets unit counts (at most max_units) and one value and unit a training document.  Without both labels, or
    without a unit that tells them apart, the result is the smoothed share of label 1, which every text then scores.
    """
    rows = map_batches(labelled(docs, labels, label, max_train_rows, id_col, text_col), _signed, "t string, y int, h long")
    # near copies count once, else every word of a copied text would tell; texts of one task share the work on their words
    rows = rows.groupBy("h").agg(F.min(F.struct("t", "y")).alias("r")).select("r.t", "r.y").coalesce(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n0, n1 = shares.get(0, 0), shares.get(1, 0)
        prior = (n1 + 1) / (n0 + n1 + 2)
        if not n0 or not n1:
            return prior

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean, toxic = Counter(), Counter()
                for text, y in zip(batch.column(0).fill_null("").to_pylist(), batch.column(1).to_pylist()):
                    (toxic if y else clean).update(units(text, pairs=False))  # joins of whole words name no insult
                keys = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_pydict({"u": pa.array(keys, pa.string()), "n1": pa.array([toxic[k] for k in keys], pa.int64()), "n0": pa.array([clean[k] for k in keys], pa.int64())})

        seen = map_batches(rows, count, "u string, n1 long, n0 long").groupBy("u").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).persist()
        p1, p0 = F.col("n1") / F.lit(float(n1)), F.col("n0") / F.lit(float(n0))
        every = (F.col("n1") + F.col("n0") + 1.0) / F.lit(float(n0 + n1 + 2))
        z = (p1 - p0) / F.sqrt(every * (1 - F.least(every, F.lit(0.999))) * (1.0 / n1 + 1.0 / n0))
        tell = seen.where(F.col("n1") >= max(2.0, MIN_SHARE * n1)).select("u", "n1", "n0", z.alias("z"), (F.log(p1 + 0.5 / n1) - F.log(p0 + 0.5 / n0)).alias("odds"))
        tell = tell.where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("z"), "u").limit(max_units).collect()
        insults = [r["u"] for r in tell if len(r["u"]) <= WIDTH][:max_insults]
        if not insults:
            seen.unpersist()
            return prior

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(holds_pairs(batch.column(0).to_pylist(), insults)))

        near = map_batches(seen.where("n0 > 0").select("u", "n0"), close, "u string, n0 long").orderBy(F.xxhash64("u"), "u").limit(max_units).collect()
        seen.unpersist()

        first = Counter({r["u"]: r["n1"] for r in tell if len(r["u"]) <= WIDTH})
        positive = first
        negative = Counter({r["u"]: r["n0"] for r in near if len(r["u"]) <= WIDTH and r["u"] not in first})
        marks = spread(insults, max_landmarks)
        model = None
        mined: set[str] = set()
        for floor in (MARGIN, FLOOR):  # the second fit only needs what its calibration does
            hard = [u for u, ok in zip(negative, holds_pairs(list(negative), insults)) if ok or u in mined]
            alike = normalised(hard, marks, kernel(marks, marks, paired=True)).max(1) if hard else np.zeros(0)
            clean = [hard[k] for k in np.lexsort((hard, -alike))[: max_landmarks // 2]]
            # gaps that labelled texts are too few to show: variants of the insults, with their weight
            spaced = {v: 1.0 * first[u] for u in insults if u in first for v in gapped(u) if v not in negative and v not in positive}
            x = [*positive, *spaced, *hard]
            y = np.array([1.0] * (len(positive) + len(spaced)) + [-1.0] * len(hard))
            w = np.array([float(n) for n in positive.values()] + list(spaced.values()) + [float(np.log1p(negative[u])) for u in hard])
            if not hard:
                x, y, w = [*x, "zzz"], np.append(y, -1.0), np.append(w, 1.0)
            model = fit_machine([*marks, *clean], insults, x, y, w)

            def score(batches: Iterator[pa.RecordBatch], model: KernelModel = model, floor: float = floor) -> Iterator[pa.RecordBatch]:
                known, bound = {}, Bound(model)
                for batch in batches:
                    best = model.best(batch.column(0).fill_null("").to_pylist(), known, bound, floor)
                    yield pa.RecordBatch.from_pydict({"y": batch.column(1), "v": pa.array([v for v, _ in best]), "u": pa.array([u for _, u in best], pa.string())})

            got = map_batches(rows, score, "y int, v double, u string").collect()
            # the variants also say where between texts without an insult and those with a plain one the line runs
            extra = model.values(list(spaced))
            extra = extra[extra > 0]
            weight = np.concatenate([np.ones(len(got)), np.full(len(extra), VARIANT_WEIGHT)])
            model.slope, model.offset = _logistic(np.concatenate([[r["v"] for r in got], extra]), np.concatenate([[float(r["y"]) for r in got], np.ones(len(extra))]), weight)
            # witnesses by the machine's own choice: telling units of toxic texts, the hardest units of clean ones
            again = Counter(r["u"] for r in got if r["y"] and r["v"] > 0 and len(r["u"]) <= WIDTH)
            positive = first | again
            for r in got:
                if not r["y"] and r["v"] > MARGIN and len(r["u"]) <= WIDTH and r["u"] not in positive:  # within the margin
                    negative[r["u"]] += 10
                    mined.add(r["u"])
        return model
    finally:
        rows.unpersist()


def score_toxicity(docs: DataFrame, model: KernelModel | float, columns: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``columns`` of every row, then score, predicted (1 if score >= threshold) and witness (its highest unit, empty where
    none is above FLOOR).

    Null and empty texts have no unit and score lowest, as do all texts without a unit above FLOOR.  Of units with one value
    the smaller string is the witness.  Texts of any length are read whole.  Repeated rows stay.
    """
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("__scored_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    stamp = repr((model.landmarks, model.weights.tolist(), model.bias)) if isinstance(model, KernelModel) else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _known:
            _known.clear()
        known = _known.setdefault(stamp, {})
        bound = Bound(model) if isinstance(model, KernelModel) else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if bound is None:
                    score, best = np.full(batch.num_rows, model), [(0.0, "")] * batch.num_rows
                else:
                    best = model.best(batch.column(batch.num_columns - 1).fill_null("").to_pylist(), known, bound)
                    score = model.probability(np.array([v for v, _ in best]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([u for _, u in best], pa.string())], names=[*names, "score", "predicted", "witness"])

    out = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("witness", T.StringType())])
    return map_batches(rows, run, out)


def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted", "witness")


QUERIES = {"op2_string_kernel": op2_string_kernel}
ORACLES: dict[str, str] = {}
