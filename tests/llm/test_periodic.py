"""Periodic runs against a word-by-word search."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import BLANK, DOCS, awkward, clashing, empty
from wavelane.llm import periodic, queries


def runs(words, min_repeats=4, min_words=6):
    found = {}
    for q in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, min_repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def periodic_words(rng):
    letters, words = "abc"[: rng.randint(1, 3)], []
    for _ in range(rng.randrange(6)):
        block = rng.choices(letters, k=rng.randint(1, 9))
        words += (block * rng.randint(1, 7))[rng.randrange(3) :] + rng.choices(letters, k=rng.randrange(4))
    return words


@pytest.mark.parametrize("base", [periodic.BASE, 1])
def test_grammar_finds_all_runs(base):
    rng = random.Random(base)
    for least in (4, 5):
        for _ in range(60):
            texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
            flat = np.array([ord(w) for t in texts for w in t], np.int64)
            doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            found = periodic.grammar_runs(flat, doc, periodic.Rules(least, 6), base)
            begin = np.cumsum([0, *map(len, texts)])
            got = [(d, i - begin[d], j - i, q) for d, i, j, q in zip(*(c.tolist() for c in found))]
            assert got == [(d, *r) for d, t in enumerate(texts) for r in runs(t, least)]


def test_long_repetitions():
    rng = random.Random(3)
    for words in (["a"] * 5000, ["a", "b"] * 3000, rng.choices("abcdefgh", k=700) * 9, [str(k) for k in range(9000)]):
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        flat = np.array([numbers[w] for w in words], np.int64)
        found = periodic.grammar_runs(flat, np.zeros(len(flat), np.int64), periodic.Rules())
        q = next((q for q in (1, 2, 700) if words[q:] == words[:-q]), None)
        assert [c.tolist() for c in found[1:]] == ([[0], [len(words)], [q]] if q else [[], [], []])


def collapsed(words, found):
    gone = {k for i, n, q in found for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_operator(spark):
    rng = random.Random(11)
    docs = awkward(spark, [" \t".join(periodic_words(rng)) for _ in range(30)] + ["no " * 9 + "\x1cé" * 3])
    want = []
    for r in docs.collect():
        words = BLANK.findall(r.text or "")
        want.append((r.doc_id, len(words), runs(words), collapsed(words, runs(words))))
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(clashing(docs)).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, 3)


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(periodic_words(rng) or ["x"]) for _ in range(60)] + [None, "", "one", " two  words "]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for k, text, *_ in rows:
        words = BLANK.findall(text or "")
        h, n = zlib.crc32(str(k).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        found = runs(words)
        r = got[k]
        assert r.n_runs == len(found) and r.collapsed_sha256 == digest(collapsed(words, found))
        assert r.runs_sha256 == digest("".join(f"{i},{m},{q}\n" for i, m, q in found))
        best = [(-m * 10**6 // q, i, q, m) for i, m, q in found]
        top = min(best) if best else None
        assert (r.start, r.length, r.period) == ((top[1], top[3], top[2]) if top else (None,) * 3)
        assert r.exponent_milli == (1000 * top[3] // top[2] if top else None)
    assert changed
