"""Ranked search against scores of every document."""

import math
import random

import numpy as np
import pytest

from tests.llm.helpers import ALNUM, awkward, clashing, empty, low
from wavelane.llm import ranked


def ranking(docs, items, k):
    docs = [(d, ALNUM.findall(low(t))) for d, t in docs if d is not None]
    n, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(ALNUM.findall(low(text)))
    df = {t: sum(t in w for _, w in docs) for words in asked.values() for t in words}
    out = []
    for item, terms in asked.items():
        scores = []
        for d, words in docs:
            score = 0
            for t in terms:
                if tf := words.count(t):
                    m = 100 - 90 + 90 * len(words) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes, a_task, k", [(1, 1, 3), (3000, 40, 4), (ranked.SHARD_BYTES, ranked.QUERY_TERMS, 10)])
def test_search(spark, shard_bytes, a_task, k):
    rng = random.Random(k)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 50}" for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    docs = awkward(spark, texts)
    items = [(f"q{n}", " ".join(rng.choices([f"W{j}" for j in range(60)], k=rng.randrange(1, 12)))) for n in range(12)]
    items += [("q1", "w3, w4!"), (None, "w1"), ("none", None), ("blank", ""), ("absent", "zzz"), ("é", "日本 ß w2")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, term string, weight int")
    got = ranked.search(clashing(docs), bench, k, shard_bytes=shard_bytes, query_terms_a_task=a_task).collect()
    want = ranking([(r.doc_id, r.text) for r in docs.collect()], items, k)
    assert sorted(map(tuple, got)) == want
    assert ranked.search(empty(spark), bench, k).count() == 0
    assert ranked.search(docs, bench.limit(0), k).count() == 0


def lists(rng, n_docs, sizes):
    """Posting lists over numbered documents, packed by the index itself."""
    import pyarrow as pa

    texts = [[] for _ in range(n_docs)]
    for t, size in enumerate(sizes):
        for d in rng.sample(range(n_docs), size):
            texts[d] += [f"t{t}"] * rng.choice([1, 1, 1, 2, 9, 300])
    shard = ranked._Shard()
    shard.add(pa.record_batch([pa.array(range(n_docs), pa.int64()), pa.array([" ".join(t) for t in texts])], ["id", "text"]))
    corpus = ranked.Corpus(n_docs, sum(map(len, texts)))
    rows = shard.lists(0, corpus).to_pylist()
    norms = np.frombuffer(rows.pop()["counts"], "<i8")
    return texts, [ranked.Postings(r | {"weight": rng.randint(0, 9000)}, norms) for r in rows], norms, [r["term"] for r in rows]


def test_blocks_are_rejected_unread():
    rng = random.Random(2)
    for _ in range(5):
        texts, held, norms, names = lists(rng, 6000, [3000, 2500, 200, 40, 3, 1])
        docs, scores = ranked.best(held, 6000, 5)
        want = []
        for d, words in enumerate(texts):
            tfs = [(p, words.count(t)) for p, t in zip(held, names)]
            s = sum(p.weight * (10**9 * tf // (1000 * tf + 8 * int(norms[d]))) for p, tf in tfs if tf)
            if s > 0:
                want.append((-s, d))
        want = sorted(want)[:5]
        assert list(zip((-scores).tolist(), docs.tolist())) == want
    # One rare, heavy term and one frequent, light one: few blocks of the latter are ever unpacked.
    _, held, *_ = lists(rng, 60_000, [30_000, 20])
    held[0].weight, held[1].weight = 3, 9000
    ranked.best(held, 60_000, 5)
    assert held[0].packed.mean() > 0.8 and not held[1].packed.any()
    assert len(ranked.best([], 10, 5)[0]) == 0
