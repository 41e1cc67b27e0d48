"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least
``max(min_words, min_repeats * q)`` that cannot be extended by a neighbouring word. The words of a slice of texts are numbered and
Re-Pair'ed: rounds replace the most frequent pairs of neighbouring symbols by new symbols, all texts of the slice sharing one
grammar. What a round replaces is every occurrence that beats the pairs it overlaps; no pair goes across two texts. When a round
hardly shortens the texts any more, the rest of each is paired off evenly, so that every text has a root.

Whatever the grammar, the smallest node that holds a run has it across the boundary of its two halves. So every node is looked at
once, where it first occurs, for the runs across that boundary: a period needs two equal blocks side by side at one
side of it, which two words, then hashes, then the words themselves decide. What a shared node has is translated to all places where it
was derived; pieces of longer runs are merged into them.

Defined results: a null or empty text, or one of blanks only, has no words and no runs, and its collapsed text is empty; a text
of any length is one task's work in memory that grows with its length; rows stay as they are, repeated or not, whatever
their id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelane.llm.common import as_bytes, map_slices

# Re-Pair ends with a round that shortens the texts by less than this share.
LEAST_GAIN = 0.02
# (node, period) pairs looked at together.
PROBE_ROWS = 1 << 20
# Multiplier of the block hashes.
BASE = 0x9E3779B97F4A7C15

RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class Rules:
    """What counts as a run."""

    min_repeats: int = 4
    min_words: int = 6

    def long_enough(self, length: np.ndarray, period: np.ndarray) -> np.ndarray:
        return length >= np.maximum(self.min_words, self.min_repeats * period)


class Hashed:
    """Words as numbers, with hashes of all blocks: equal blocks have equal hashes."""

    def __init__(self, words: np.ndarray, base: int = BASE) -> None:
        self.words = words
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        value ^= value >> np.uint64(29)
        self.power = np.ones(len(words) + 1, np.uint64)
        np.cumprod(np.full(len(words), base, np.uint64), out=self.power[1:])
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(value * self.power[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the blocks at ``a`` and ``a + shift`` hash alike."""
        b = a + shift
        left = (self.sums[a + length] - self.sums[a]) * self.power[shift]
        return left == self.sums[b + length] - self.sums[b]

    def reach(self, a: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Words after ``a`` (before it, with ``back``), ``most`` at most, that recur ``shift`` later."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            ok = self.same(a - half if back else a, shift, half)
            low = np.where(open_ & ok, half, low)
            high = np.where(open_ & ~ok, half - 1, high)
        return low


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the numbers 1 .. count: (entry, number)."""
    entry = np.repeat(np.arange(len(count)), count)
    return entry, np.arange(len(entry)) - (np.cumsum(count) - count)[entry] + 1


def _slices(count: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of entries with ``most`` numbers together, one entry at least."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right"))
        yield slice(a, max(b, a + 1))
        a = max(b, a + 1)


def _word_by_word(words: np.ndarray, s: int, m: int, e: int, rules: Rules) -> list[tuple[int, int, int]]:
    """Runs of one node across its boundary, without hashes."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, (e - s) // rules.min_repeats + 1):
        equal = words[s : e - q] == words[s + q : e]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if s + a < m < s + b + q and b + q - a >= max(rules.min_words, rules.min_repeats * q):
                found.setdefault((s + a, s + b + q), q)
    return [(i, j, q) for (i, j), q in found.items()]


def crossing(text: Hashed, s: np.ndarray, m: np.ndarray, e: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs in [s, e) across m, extended as far as the node goes."""
    w = text.words
    rows = []
    for left in (True, False):
        count = np.minimum((m - s if left else e - m) // 2, (e - s) // rules.min_repeats)
        count[e - s < rules.min_words] = 0
        for part in _slices(count, PROBE_ROWS):
            node, q = _ranges(count[part])
            node += part.start
            mid = m[node]
            # The boundary's two words recur one period before (or after) it.
            first = mid - 1 - q if left else mid - 1
            ok = w[first] == w[first + q]
            node, q, mid = node[ok], q[ok], mid[ok]
            ok = w[mid - q] == w[mid] if left else w[mid] == w[mid + q]
            node, q, mid = node[ok], q[ok], mid[ok]
            ok = text.same(mid - 2 * q if left else mid, q, q)
            node, q, mid = node[ok], q[ok], mid[ok]
            inside = mid - q if left else mid
            start = inside - text.reach(inside, q, inside - s[node], True)
            end = inside + q + text.reach(inside, q, e[node] - q - inside, False)
            ok = rules.long_enough(end - start, q)
            rows.append(np.stack([node[ok], start[ok], end[ok], q[ok]]))
    node, start, end, q = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
    # A multiple of the smallest period has the same stretch.
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    node, start, end, q = node[new], start[new], end[new], q[new]

    def holds(n: int, i: int, j: int, p: int) -> bool:
        whole = np.array_equal(w[i : j - p], w[i + p : j])
        return whole and (i == s[n] or w[i - 1] != w[i - 1 + p]) and (j == e[n] or w[j] != w[j - p])

    wrong = {n for n, *run in zip(node.tolist(), start.tolist(), end.tolist(), q.tolist()) if not holds(n, *run)}
    if wrong:
        # Different blocks with equal hashes.
        kept = ~np.isin(node, list(wrong))
        again = [(n, *r) for n in wrong for r in _word_by_word(w, int(s[n]), int(m[n]), int(e[n]), rules)]
        more = np.array(again, np.int64).reshape(-1, 4).T
        node, start, end, q = np.concatenate([np.stack([node, start, end, q])[:, kept], more], axis=1)
    return node, start, end, q


def _best_pairs(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs a round replaces and the keys of all pairs."""
    key = sym[:-1] * (int(sym.max()) + 1) + sym[1:]
    _, pair, count = np.unique(key, return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(-count, kind="stable")] = np.arange(len(count))
    rank = place[pair]
    rank[(count[pair] < 2) | (doc[1:] != doc[:-1])] = len(count)
    # Equal neighbours are overlapping pairs of one repeated symbol: every other one of them is taken.
    first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    held = np.concatenate([[len(count)], rank[first], [len(count)]])
    wins = (held[1:-1] < held[:-2]) & (held[1:-1] < held[2:])
    width = np.diff(np.append(first, len(rank)))
    group, turn = _ranges(np.where(wins, (width + 1) // 2, 0))
    return first[group] + 2 * (turn - 1), key


def grammar_runs(words: np.ndarray, doc: np.ndarray, rules: Rules, base: int = BASE) -> tuple[np.ndarray, ...]:
    """(doc, start, end, period) of all runs, sorted, for texts laid one after the other."""
    text = Hashed(words, base)
    size = len(words)
    sym, at, owner = words.astype(np.int64), np.arange(size), doc
    found: list[np.ndarray] = []
    # Rules by the pair they stand for; runs of a rule from its start.
    names: dict[tuple[int, int], int] = {}
    top = int(words.max(initial=0)) + 1
    runs_of: dict[int, list[tuple[int, int, int]]] = {}

    def ends(k: np.ndarray) -> np.ndarray:
        return np.append(at, size)[k + 2]

    while len(sym) > 1:
        chosen, key = _best_pairs(sym, owner)
        if len(chosen) < LEAST_GAIN * len(sym):
            break
        _, where, pair = np.unique(key[chosen], return_index=True, return_inverse=True)
        lead = chosen[where]
        name = np.empty(len(lead), np.int64)
        fresh = []
        for n, both in enumerate(zip(sym[lead].tolist(), sym[lead + 1].tolist())):
            if both not in names:
                names[both] = top + len(names)
                fresh.append(n)
            name[n] = names[both]
        k = lead[fresh]
        node, start, end, q = crossing(text, at[k], at[k + 1], ends(k), rules)
        for n, i, j, p in zip(node.tolist(), (start - at[k][node]).tolist(), (end - at[k][node]).tolist(), q.tolist()):
            runs_of.setdefault(int(name[fresh[n]]), []).append((i, j, p))
        # All places where a rule with runs was derived.
        for n in [n for n, rule in enumerate(name.tolist()) if rule in runs_of] if runs_of else ():
            places = at[chosen[pair == n]]
            found += [np.stack([places + i, places + j, np.full(len(places), p)]) for i, j, p in runs_of[int(name[n])]]
        sym[chosen] = name[pair]
        stays = np.ones(len(sym), bool)
        stays[chosen + 1] = False
        sym, at, owner = sym[stays], at[stays], owner[stays]
    while len(at) > 1:
        # Neighbours with an even and an odd number in one text are paired.
        turn = np.arange(len(owner)) - np.searchsorted(owner, owner)
        k = np.flatnonzero((turn[:-1] % 2 == 0) & (owner[1:] == owner[:-1]))
        if not len(k):
            break
        found.append(np.stack(crossing(text, at[k], at[k + 1], ends(k), rules)[1:]))
        stays = np.ones(len(at), bool)
        stays[k + 1] = False
        at, owner = at[stays], owner[stays]
    start, end, q = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return _merged(doc[start], start, end, q, size)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs without those that are pieces of others with the same period."""
    order = np.lexsort((-end, start, q, doc))
    doc, start, end, q = doc[order], start[order], end[order], q[order]
    if len(doc):
        new = np.append(True, (doc[1:] != doc[:-1]) | (q[1:] != q[:-1]))
        furthest = np.maximum.accumulate(np.cumsum(new) * (size + 1) + end)
        keep = np.append(True, new[1:] | (furthest[1:] > furthest[:-1]))
        doc, start, end, q = doc[keep], start[keep], end[keep], q[keep]
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], end[order], q[order]


def _runs_of_slice(piece: pa.RecordBatch, rules: Rules) -> pa.RecordBatch:
    split = [t.split() for t in as_bytes(piece.column(1))]
    count = np.array([len(s) for s in split], np.int64)
    begin = np.cumsum(count) - count
    flat = pa.array(chain.from_iterable(split), pa.binary())
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc, start, end, q = grammar_runs(words, np.repeat(np.arange(len(split)), count), rules)
    # What follows the first period of a run is dropped.
    cuts = np.zeros(len(words) + 1, np.int64)
    np.add.at(cuts, start + q, 1)
    np.add.at(cuts, end, -1)
    kept = np.cumsum(cuts[:-1]) == 0
    collapsed = []
    per_doc = np.bincount(doc, minlength=len(split))
    for n, own in enumerate(split):
        if per_doc[n]:
            stays = kept[begin[n] : begin[n] + count[n]]
            own = [own[k] for k in np.flatnonzero(stays).tolist()]
        collapsed.append(b" ".join(own))
    entries = pa.StructArray.from_arrays(
        [pa.array(start - begin[doc]), pa.array(end - start), pa.array(q)], fields=list(RUN_TYPE)
    )
    offsets = pa.array(np.append(0, np.cumsum(per_doc)), pa.int32())
    columns = [
        piece.column(0),
        pa.array(count),
        pa.ListArray.from_arrays(offsets, entries),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.record_batch(columns, ["id", "n_words", "runs", "collapsed"])


def periodic_runs(
    docs: DataFrame,
    min_repeats: int = 4,
    min_words: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of each text by (start, period), and the text without their repeats.

    Words are cut at blanks and numbered from 0; the collapsed text has its words joined by one blank. Four repeats at least
    leave two on one side of any boundary, which is what the search goes by.
    """
    if min_repeats < 4:
        raise ValueError("runs of fewer than four repeats are not searched for")
    rules = Rules(min_repeats, min_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_slices(rows, lambda piece: _runs_of_slice(piece, rules), schema)
