"""Grouped prefix join against all pairs."""

import random

import pytest

from tests.llm.helpers import BLANK, Sets, awkward, clashing, empty, low
from wavelane.llm import grouped_join


def shingles(text, width):
    words = BLANK.findall(low(text))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def components(docs, width, percent):
    sets = [(d, shingles(t, width)) for d, t in docs]
    joined = Sets(range(len(sets)))
    for i, (d, x) in enumerate(sets):
        for j in range(i):
            e, y = sets[j]
            if x and y and d is not None and e is not None and 100 * len(x & y) >= percent * len(x | y):
                joined.join(i, j)
    named = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            root = joined.find(i)
            named[root] = min(named.get(root, d), d)
    return sorted((d if d is not None else -1, len(x), named.get(joined.find(i)) if d is not None else None) for i, (d, x) in enumerate(sets))


@pytest.mark.parametrize("width, percent, cell_bits", [(5, 80, 20), (2, 60, 4), (1, 75, 1)])
def test_components(spark, width, percent, cell_bits):
    rng = random.Random(width)
    texts = []
    for _ in range(12):
        # A family about the threshold: relatives of relatives, in one chain or another.
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 50))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
            words += [f"w{rng.randrange(30)}"] * rng.randrange(3)
    # Sets that differ in their common shingles only have one prefix.
    texts += [" ".join(rng.sample("a b c d e f g h".split(), rng.randrange(1, 8))) for _ in range(20)]
    docs = awkward(spark, texts)
    want = components([(r.doc_id, r.text) for r in docs.collect()], width, percent)
    found = grouped_join.similar_components(clashing(docs), width, percent, cell_bits=cell_bits).collect()
    assert sorted((r.id if r.id is not None else -1, r.n, r.component) for r in found) == want
    if width == 5:
        assert grouped_join.similar_components(empty(spark)).count() == 0


def test_filters_prune(spark):
    units = "shingle bigint, group bigint, component bigint, n bigint, at int"
    rows = [(1, 10, 10, 100, 0), (1, 11, 11, 70, 0), (1, 12, 12, 100, 16), (1, 13, 13, 90, 0), (1, 14, 14, 90, 15)]
    # Two shingles in common, with too many others between them.
    rows += [(3, 30, 30, 50, 0), (4, 30, 30, 50, 8), (3, 31, 31, 50, 0), (4, 31, 31, 50, 8), (3, 32, 32, 50, 1), (4, 32, 32, 50, 2)]
    rows += [(2, 10, 10, 100, 1), (2, 20, 10, 100, 1)]
    found = {(r.group, r._group) for r in grouped_join._group_pairs(spark.createDataFrame(rows, units), 80).collect()}
    # Sizes 100 and 70 cannot reach it, nor can places behind which too little is left; one component asks nothing.
    assert found == {(10, 13)}
    near = [(k, g, g, 50, k) for k in range(3) for g in (30, 31)]
    pairs = grouped_join._group_pairs(spark.createDataFrame(near, units), 80).collect()
    assert [(r.group, r._group) for r in pairs] == [(30, 31)]


@pytest.mark.parametrize("beside", [0, 1])
def test_members_of_one_group_meet_each_other(spark, beside):
    """Twelve texts with one prefix of rare words, in six pairs of near copies: whichever is the group's first, it is like one other only."""
    rare = [f"rare{k}" for k in range(5)]
    texts = []
    for k in range(6):
        often = [f"often{k}x{j}" for j in range(16)]
        for end in (15, 16):
            texts.append(" ".join(rare + (often[:14] + often[end - 1 : end]) * 40))
    # Another group has one of the prefix's words as well, or none.
    texts += [" ".join(["rare4", *[f"other{j}" for j in range(19)]])] * beside
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = components(list(enumerate(texts)), 1, 80)
    assert [c for _, _, c in want[:12]] == [k - k % 2 for k in range(12)]
    found = grouped_join.similar_components(docs, 1, 80).collect()
    assert sorted((r.id, r.n, r.component) for r in found) == want
