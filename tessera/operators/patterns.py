"""Many patterns found in one pass over the texts, by an automaton in flat arrays.

The patterns are a trie; its edges lie in one open hash table, the fail links (the
longest proper suffix that is a trie node) and the jumps to the next node on the
fail path where a pattern ends in two arrays. Where a table of the next node by node
and character is small enough, it takes the place of the hash table, and case is
folded by the same look-up. A task cuts its texts into stretches
of equal length that overlap by the longest pattern, and walks all stretches at
once, a character a step. The time hardly depends on the number of patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a stretch; characters walked at once; bytes of patterns (four a character) of one automaton; bytes of its table of next nodes, where it has one.
STRETCH, WALKED, PATTERN_BYTES, TABLE_BYTES = 2048, 1 << 22, 32 << 20, 32 << 20
POINTS = 0x110000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(codes: np.ndarray) -> np.ndarray:
    """Each character's lower case where that is one character, so that places stay."""
    own, at = np.unique(codes, return_inverse=True)
    lower = [chr(c).lower() for c in own.tolist()]
    return np.array([ord(x) if len(x) == 1 else c for x, c in zip(lower, own.tolist(), strict=True)], np.uint32)[at] if len(own) else codes


@lru_cache(maxsize=1)
def folded_points() -> np.ndarray:
    return folded(np.arange(POINTS, dtype=np.uint32))


class Automaton:
    """Trie nodes are numbered by depth, the root is 0. patterns: different, not empty."""

    def __init__(self, patterns: list[str], ignore_case: bool = False, table_bytes: int | None = None):
        self.ignore_case = ignore_case
        codes = [folded(code_points(p)) if ignore_case else code_points(p) for p in patterns]
        self.longest = max(map(len, codes), default=0)
        at = np.zeros(len(codes), np.int64)  # the node of each pattern's first characters
        size = 1 + sum(map(len, codes))
        self.slots = 1 << max(4, (2 * size).bit_length())
        self.keys = np.full(self.slots, -1, np.int64)
        self.child = np.zeros(self.slots, np.int64)
        nodes = 1
        fail, ends, fails, levels = [np.zeros(1, np.int64)], {}, np.zeros(1, np.int64), []
        for depth in range(self.longest):
            longer = np.array([i for i, c in enumerate(codes) if len(c) > depth], np.int64)
            letters = np.array([codes[i][depth] for i in longer.tolist()], np.int64)
            edges, which = np.unique(at[longer] << 21 | letters, return_inverse=True)
            numbers = nodes + np.arange(len(edges))
            if depth:
                # the suffix links of this depth need only what is shallower
                fails = self.step(fails[edges >> 21], edges & ((1 << 21) - 1), fails)
                fail.append(fails)
                fails = np.concatenate(fail)
            else:
                fail.append(np.zeros(len(edges), np.int64))
                fails = np.concatenate(fail)
            self._put(edges, numbers)
            levels.append((edges, numbers))
            nodes += len(edges)
            at[longer] = numbers[which]
        for i, node in enumerate(at.tolist()):
            ends.setdefault(node, []).append(i)
        self.fail = fails
        # patterns (of equal characters) that end at a node, as a range
        self.first, self.ended = np.zeros(nodes + 1, np.int64), np.array([i for n in sorted(ends) for i in ends[n]], np.int64)
        for node, own in ends.items():
            self.first[node + 1] = len(own)
        self.first = np.cumsum(self.first)
        some = np.diff(self.first) > 0
        self.jump = np.zeros(nodes, np.int64)  # the next node on the fail path with an end, 0 for none
        at_depth = 1
        for level in fail[1:]:
            own = np.arange(at_depth, at_depth + len(level))
            self.jump[own] = np.where(some[level], level, self.jump[level])
            at_depth += len(level)
        self.hits = some | (self.jump > 0)
        self.classes = self.next = None
        letters = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint32)
        self.width = len(letters) + 1
        if 4 * nodes * self.width <= (TABLE_BYTES if table_bytes is None else table_bytes):
            self._tabulate(letters, nodes, levels)

    def _tabulate(self, letters: np.ndarray, nodes: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The class of each code point (0: in no pattern), and the next node by node and class."""
        self.classes = np.zeros(POINTS, np.int32)
        self.classes[letters] = np.arange(1, self.width)
        if self.ignore_case:
            self.classes = self.classes[folded_points()]
        self.next = np.zeros((nodes, self.width), np.int32)
        own = np.zeros(1, np.int64)
        for edges, numbers in levels:
            # nodes of one depth: where their fail links lead, which are shallower, but for their own edges
            self.next[own] = self.next[self.fail[own]]
            self.next[edges >> 21, np.searchsorted(letters, edges & ((1 << 21) - 1)) + 1] = numbers
            own = numbers
        self.next[own] = self.next[self.fail[own]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]], self.child[slot[taken]] = keys[taken], values[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (self.slots - 1)

    def _get(self, keys: np.ndarray) -> np.ndarray:
        """The child of each edge, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        slot, alive = self._slot(keys), np.arange(len(keys))
        while len(alive):
            held = self.keys[slot[alive]]
            hit = held == keys[alive]
            out[alive[hit]] = self.child[slot[alive[hit]]]
            alive = alive[~hit & (held != -1)]
            slot[alive] = (slot[alive] + 1) & (self.slots - 1)
        return out

    def step(self, states: np.ndarray, letters: np.ndarray, fail: np.ndarray | None = None) -> np.ndarray:
        """The states after one more letter each."""
        fail = self.fail if fail is None else fail
        out = np.zeros(len(states), np.int64)
        at, alive = states.copy(), np.arange(len(states))
        while len(alive):
            found = self._get(at[alive] << 21 | letters[alive])
            hit = found >= 0
            out[alive[hit]] = found[hit]
            alive = alive[~hit & (at[alive] > 0)]
            at[alive] = fail[at[alive]]
        return out

    def find(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, pattern) of all hits in texts joined to codes, in whatever case; ends: where each text ends. end is the place after the hit, in codes."""
        if not self.longest or not len(codes):
            return (np.zeros(0, np.int64),) * 3
        if self.next is not None:
            codes, table = self.classes[codes], self.next.ravel()
        elif self.ignore_case:
            codes = folded(codes)
        starts = np.concatenate(([0], ends[:-1]))
        counts = -(-(ends - starts) // STRETCH)
        text = np.repeat(np.arange(len(ends)), counts)
        begin = starts[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
        # a stretch is entered early, so that hits that began before are known; they end inside
        enter = np.maximum(begin - (self.longest - 1), starts[text])
        stop = np.minimum(begin + STRETCH, ends[text])
        order = np.argsort(enter - stop, kind="stable")  # the longest first: those that go on are a prefix
        text, begin, enter, stop = text[order], begin[order], enter[order], stop[order]
        length = stop - enter
        states = np.zeros(len(text), np.int64)
        found = []
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k, "left"))  # those of more than k characters
            letters = codes[enter[:n] + k]
            states[:n] = table[states[:n] * self.width + letters] if self.next is not None else self.step(states[:n], letters.astype(np.int64))
            at = np.flatnonzero(self.hits[states[:n]] & (enter[:n] + k >= begin[:n]))
            if len(at):
                found.append((at, states[at], enter[at] + k + 1))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        which, node, end = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(which):  # all that end here: at the node, then where the jumps lead
            number = self.first[node + 1] - self.first[node]
            inner = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            out.append((np.repeat(text[which], number), np.repeat(end, number), self.ended[np.repeat(self.first[node], number) + inner]))
            node = self.jump[node]
            on = node > 0
            which, node, end = which[on], node[on], end[on]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def groups_of(patterns: list[str], most_bytes: int) -> list[list[str]]:
    """Patterns in order of their letters, cut where a group's bytes reach the bound."""
    out, held = [[]], 0
    for p in sorted(patterns):
        if held and held + 4 * len(p) > most_bytes:
            out.append([])
            held = 0
        out[-1].append(p)
        held += 4 * len(p)
    return out


def find_patterns(texts: DataFrame, patterns: DataFrame, ignore_case: bool = False, most_bytes: int = PATTERN_BYTES) -> DataFrame:
    """text_id, pattern, start (from 0) of all hits, overlapping ones too, of patterns (pattern) in texts (text_id, text).

    Patterns are a stated set that the driver holds; empty and null ones have no
    hits, repeated ones count once. An automaton of up to most_bytes of them is
    broadcast; further ones, next in their letters' order, take a pass of their own. With ignore_case,
    characters are compared in lower case one by one, and the pattern comes back
    as it was given. Null and empty texts have no hits.
    """
    wanted = [r[0] for r in patterns.where(F.length("pattern") > 0).select("pattern").distinct().collect()]
    spark, out = texts.sparkSession, None
    kind = dict(texts.dtypes)["text_id"]
    for group in groups_of(wanted, most_bytes):
        shared = spark.sparkContext.broadcast((Automaton(group, ignore_case), group))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton, names = shared.value
            sizes = np.array([len(code_points(p)) for p in names], np.int64)
            for rows in batches:
                a = 0
                while a < rows.num_rows:
                    b, held, codes = a, 0, []
                    while b < rows.num_rows and (not held or held < WALKED):
                        codes.append(code_points(rows.column(1)[b].as_py() or ""))
                        held += len(codes[-1])
                        b += 1
                    whole = np.concatenate(codes)
                    ends = np.cumsum([len(c) for c in codes])
                    text, end, which = automaton.find(whole, ends)
                    start = end - sizes[which] - (ends - np.diff(ends, prepend=0))[text] if len(text) else end
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(a + text)), pa.array(names, pa.string()).take(pa.array(which)), pa.array(start, pa.int32())], names=["text_id", "pattern", "start"])
                    a = b

        found = texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, pattern string, start int")
        out = found if out is None else out.unionByName(found)
    return out
