"""Subword lattices over tries of words: best and summed segmentations of many words at once.

A vocabulary of pieces weighs every way to cut a word. Words are given as bytes; sorted, they share a trie whose nodes are
their distinct prefixes, and every quantity of a prefix is worked out once, level by level, for all words that have it.
Every byte has a piece of its own, so every word has a segmentation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def _hash_step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h + byte.astype(np.uint64) + np.uint64(1)) * _BASE


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ h >> np.uint64(29)) >> np.uint64(64 - _SLOTS - 8)).astype(np.int64) & ((1 << _SLOTS) - 1)


@dataclass
class Pieces:
    """Pieces by hash, and the piece of every single byte; ids are positions in the vocabulary."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray
    sizes: np.ndarray  # distinct byte lengths
    taken: np.ndarray  # slots that a piece's hash falls into
    byte_ids: np.ndarray
    count: int


def pieces(texts: list[bytes | None], byte_ids: list[int]) -> Pieces:
    """``texts`` has the bytes of each piece, or None for pieces that never match; ``byte_ids`` the piece of every byte."""
    known = [(k, t) for k, t in enumerate(texts) if t]
    hashes = np.zeros(len(known), np.uint64)
    for size in {len(t) for _, t in known}:
        rows = [n for n, (_, t) in enumerate(known) if len(t) == size]
        raw = np.frombuffer(b"".join(known[n][1] for n in rows), np.uint8).reshape(len(rows), size)
        h = np.zeros(len(rows), np.uint64)
        for k in range(size):
            h = _hash_step(h, raw[:, k])
        hashes[rows] = h
    order = np.argsort(hashes)
    hashes = hashes[order]
    if len(np.unique(hashes)) != len(hashes):
        raise ValueError("two pieces share a hash or a text")
    taken = np.zeros(1 << _SLOTS, bool)
    taken[_slot(hashes)] = True
    ids = np.array([k for k, _ in known], np.int64)[order]
    sizes = np.array(sorted({len(t) for _, t in known}), np.int64)
    return Pieces(hashes, ids, sizes, taken, np.array(byte_ids, np.int64), len(texts))


@dataclass
class Trie:
    """Nodes 1.. are distinct prefixes in order of depth, node 0 the empty one; edges are pieces that end at ``high``."""

    levels: np.ndarray  # first node of every depth, with the end
    terminal: np.ndarray  # node of every word
    low: np.ndarray  # edges, sorted by high
    high: np.ndarray
    piece: np.ndarray


def build(words: list[bytes], p: Pieces) -> Trie:
    """The trie of distinct, sorted words with all pieces in it. No word may be empty."""
    sizes = np.array([len(w) for w in words], np.int64)
    deepest = int(sizes.max()) if len(words) else 0
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(words), np.uint8)
    # Bytes that each word shares with the one before.
    shared = np.zeros(len(words), np.int64)
    alive = np.arange(1, len(words))
    for d in range(deepest):
        alive = alive[(sizes[alive] > d) & (sizes[alive - 1] > d)]
        alive = alive[raw[begins[alive] + d] == raw[begins[alive - 1] + d]]
        if not len(alive):
            break
        shared[alive] = d + 1
    levels = [0, 1]
    terminal = np.zeros(len(words), np.int64)
    # Node of every word's prefix at each of the last depths, as far back as the longest piece reaches.
    reach = int(p.sizes.max()) if len(p.sizes) else 1
    usable = set(p.sizes.tolist())
    paths: list[np.ndarray] = [np.zeros(len(words), np.int64)]
    hashes: list[np.ndarray] = []
    lows, highs, kinds = [], [], []
    rows = np.arange(len(words))
    count = 1
    for d in range(deepest):
        keep = sizes[rows] > d
        rows = rows[keep]
        paths = [q[keep] for q in paths]
        hashes = [h[keep] for h in hashes]
        byte = raw[begins[rows] + d]
        new = shared[rows] <= d
        node = count - 1 + np.cumsum(new)
        first = np.flatnonzero(new)
        count += len(first)
        levels.append(count)
        ends = sizes[rows] == d + 1
        terminal[rows[ends]] = node[ends]
        # Hashes of the last 1, 2, ... bytes, for the first word of each node only.
        hashes = [np.zeros(len(rows), np.uint64), *hashes][:reach]
        hashes = [_hash_step(h, byte) for h in hashes]
        lows.append(paths[0][first])
        highs.append(node[first])
        kinds.append(p.byte_ids[byte[first]])
        for back, h in enumerate(hashes, 1):
            if back not in usable:
                continue
            h = h[first]
            maybe = np.flatnonzero(p.taken[_slot(h)])
            at = np.minimum(np.searchsorted(p.hashes, h[maybe]), len(p.hashes) - 1)
            hit = p.hashes[at] == h[maybe]
            lows.append(paths[back - 1][first[maybe[hit]]])
            highs.append(node[first[maybe[hit]]])
            kinds.append(p.ids[at[hit]])
        paths = [node, *paths][:reach]
    low, high, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lows, highs, kinds))
    order = np.argsort(high, kind="stable")
    return Trie(np.array(levels, np.int64), terminal, low[order], high[order], piece[order])


def _level_edges(t: Trie) -> np.ndarray:
    """First edge of every depth's nodes, from depth 1, with the end."""
    return np.searchsorted(t.high, t.levels[1:])


def forward(t: Trie, log_weight: np.ndarray) -> np.ndarray:
    """Log weight of all segmentations of every prefix together."""
    score = np.zeros(int(t.levels[-1]))
    cuts = _level_edges(t)
    for a, b in zip(cuts, cuts[1:]):
        value = score[t.low[a:b]] + log_weight[t.piece[a:b]]
        starts = np.flatnonzero(np.append(True, t.high[a + 1 : b] != t.high[a : b - 1]))
        most = np.maximum.reduceat(value, starts)
        counts = np.diff(np.append(starts, b - a))
        total = np.add.reduceat(np.exp(value - np.repeat(most, counts)), starts)
        score[t.high[a:b][starts]] = most + np.log(total)
    return score


def expected_counts(t: Trie, log_weight: np.ndarray, word_counts: np.ndarray, kinds: int) -> np.ndarray:
    """How often each piece is expected among all segmentations of the words, each counted as often as it occurs.

    Backward weights of the words below a node are added up in the trie, each divided by its word's weight.
    """
    alpha = forward(t, log_weight)
    beta = np.full(len(alpha), -np.inf)
    beta[t.terminal] = np.log(word_counts) - alpha[t.terminal]
    cuts = _level_edges(t)
    out = np.zeros(kinds)
    for a, b in reversed(list(zip(cuts, cuts[1:]))):
        low, high, weight = t.low[a:b], t.high[a:b], log_weight[t.piece[a:b]]
        flow = weight + beta[high]
        out += np.bincount(t.piece[a:b], np.exp(alpha[low] + flow), kinds)
        order = np.argsort(low, kind="stable")
        low, flow = low[order], flow[order]
        starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        nodes = low[starts]
        most = np.maximum(np.maximum.reduceat(flow, starts), beta[nodes])
        counts = np.diff(np.append(starts, len(low)))
        total = np.add.reduceat(np.exp(flow - np.repeat(most, counts)), starts) + np.exp(beta[nodes] - most)
        beta[nodes] = most + np.log(total)
    return out


def best(t: Trie, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, number of pieces) of the best segmentation of every prefix; among equals the one with fewest pieces."""
    score = np.zeros(int(t.levels[-1]))
    count = np.zeros(len(score), np.int64)
    cuts = _level_edges(t)
    for a, b in zip(cuts, cuts[1:]):
        value = score[t.low[a:b]] + log_weight[t.piece[a:b]]
        used = count[t.low[a:b]] + 1
        order = np.lexsort((used, -value, t.high[a:b]))
        high = t.high[a:b][order]
        first = order[np.append(True, high[1:] != high[:-1])]
        score[t.high[a:b][first]] = value[first]
        count[t.high[a:b][first]] = used[first]
    return score, count


def load(path: str) -> tuple[Pieces, np.ndarray]:
    """The pieces of a vocabulary file and the log weights that its scores give them.

    The file's scores are minus the ranks of its pieces, so weights fall off by rank as word frequencies do;
    single bytes, which the file does not rank, come last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    texts: list[bytes | None] = [None] * size
    byte_ids = [0] * 256
    rank = np.full(size, float(size))
    for k in range(size):
        name = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(name[1:-1], 16)] = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) and model.get_score(k) > -size:
            texts[k] = name.encode()
            rank[k] = -model.get_score(k)
    weight = 1 / (rank + 10)
    return pieces(texts, byte_ids), np.log(weight / weight.sum())


# What marks the beginning of a word in the pieces.
MARK = "▁".encode()
# Words put into one trie.
TRIE_WORDS = 40_000
