"""Encoding, chat, quality, licenses, language model and token counts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ALNUM, BLANK, DOCS, awkward, clashing, empty, low, prose
from wavelane.llm import bpe, chat, language_model, lattice, licenses, quality, token_counts

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_bpe_round_trip(spark):
    rng = random.Random(1)
    letters = "abcdeéΣς'st 1!<|>İǅﬁ"
    more = ["".join(rng.choice(letters) for _ in range(120)) for _ in range(60)]
    more += ["it's I'LL don't", "a" * 3000 + " " + "ab" * 999, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>"]
    more += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(80)) for _ in range(40)]
    docs = awkward(spark, more)
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = bpe.decode(bpe.encode(clashing(docs), BPE), BPE).collect()
    assert len(found) == docs.count()
    for r in found:
        want = library.encode(texts[r.id], add_special_tokens=False).ids
        assert r.ids == want and r.text == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty(spark), BPE).count() == 0


def test_one_merge_at_a_time_where_order_matters():
    v = bpe.load(BPE)
    words = [b"aaaaaaa", b"abababab", b"thethethe", b"x"]
    whole = bpe.encode_words(v, words)
    v.whole = np.zeros_like(v.whole)
    assert all((a == b).all() for a, b in zip(whole, bpe.encode_words(v, words)))


def test_chat_events(spark):
    events = [
        (1, 1, "delta", 0, "user", "he"), (1, 2, "delta", 0, "user", "y"), (1, 3, "delta", 1, "assistant", "bad"),
        (1, 4, "regenerate", 1, "assistant", None), (1, 5, "delta", 1, "assistant", "go"), (1, 6, None, 1, "assistant", "od"),
        (1, 7, "edit", 0, "user", "hi"), (1, 8, "delta", 2, "user", "gone"), (1, 9, "delete", 2, "user", None),
        (1, 9, "noise", 3, "user", "?"), (2, 1, "delta", 0, None, None), (None, 1, "delta", 0, "assistant", "x"),
    ]
    log = spark.createDataFrame(events, "conv_id bigint, seq bigint, kind string, message bigint, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.messages(clashing(log)).collect()}
    assert got == {
        (1, 0): ("user", "hi"), (1, 1): ("assistant", "good"), (2, 0): ("", ""), (None, 0): ("assistant", "x")
    }


def test_chat_escapes(spark):
    rng = random.Random(3)
    pieces = ["<|", "<\\|", "|>", "\\", "<", "|", "<|im_end|>\n", "%0A", "%", "\n", "é", "a"]
    rows = [(k, 0, "assistant" if k % 2 else "".join(rng.choices(pieces, k=3)), "".join(rng.choices(pieces, k=9))) for k in range(200)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in chat.render(chat.messages(chat.turn_events(turns))).collect():
        assert chat.parse(r.segment) == rows[r.conv_id][2:]
        assert r.segment.count("<|im_start|>") == 1 and r.segment.count("<|im_end|>") == 1


def test_chat_digests(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, "é"), (None, 5, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.messages(chat.turn_events(turns)))).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (4, h("user\na\nassistant\n\nassistant\nb\nassistant\nb\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, h("bb"))
    assert got[2].loss_sha256 == h("") and got[None].loss_sha256 == h("z")
    none = turns.limit(0)
    assert chat.digests(chat.render(chat.messages(chat.turn_events(none)))).count() == 0


def test_chat_log_decides(spark):
    """Turns come back from logs with drafts, edits, regenerations and deleted messages; a very long one as well."""
    rng = random.Random(9)
    rows = [(k % 40, k, rng.choice(["user", "assistant"]), "".join(rng.choices("abé \n<|", k=rng.randrange(12)))) for k in range(400)]
    rows.append((40, 0, "assistant", "long é " * 700_000))
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    log = chat.turn_events(clashing(turns))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.KINDS) and min(kinds.values()) > 30
    # Without the fold the texts would be others: most messages hold more in the log than in the end.
    said = log.groupBy("conv_id", "message").agg(F.sum(F.length("text")).alias("n"))
    assert said.filter("n > 0").count() > 300
    final = chat.messages(log)
    got = sorted((r.conv_id, r.message.turn, r.role, hash(r.text)) for r in final.collect())
    assert got == sorted((c, t, role, hash(text)) for c, t, role, text in rows)
    digests = {r.conv_id: r for r in chat.digests(chat.render(final)).collect()}
    assert digests[40].loss_chars == 7 * 700_000


def counts(text):
    words = BLANK.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    worded = [s for s in (text or "").split("\n") if BLANK.search(s)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(worded) - len(set(worded)), len(covered)


def test_quality_counts(spark):
    docs = awkward(spark, ["a b c a b c\na b c", "x\n \nx\n\n", "# é *\t<|>"])
    for r in quality.verdicts(clashing(docs)).join(docs.withColumnRenamed("doc_id", "id").dropDuplicates(["id"]), "id").collect():
        want = counts(r.text)
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.verdicts(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def estimate(x, floors, core=0.75):
    """Plain concentration steps from the same start, with exact quantiles."""
    middle = np.median(x, axis=0)
    spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
    cov = np.diag(spread**2)
    for _ in range(30):
        d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov + np.diag(floors**2)), x - middle)
        near = x[d <= np.quantile(d, core)]
        middle, cov = near.mean(axis=0), np.cov(near.T, bias=True)
    d = np.einsum("ij,jk,ik->i", x - middle, np.linalg.inv(cov + np.diag(floors**2)), x - middle)
    return d / max(np.median(d) / quality.MEDIAN_5, 1)


def test_outliers_are_rejected(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(60, 400), 3000) for _ in range(300)]
    bad = [" ".join(f"w{rng.randrange(3000)}$$$" for _ in range(100)) for _ in range(6)]
    rows = [(k, t, "en", "s" if k % 3 else "t", 0) for k, t in enumerate(texts + bad)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.id: r for r in quality.verdicts(docs).collect()}
    assert all(found[k].kept for k in range(300)) and not any(found[k].kept for k in range(300, 306))
    kept = quality.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == set(range(300))
    for source in "st":
        own = [k for k, *_, s, _ in rows if s == source and not found[k].base_failed]
        n = np.array([[found[k][c] for c in quality.COUNTS] for k in own], float)
        x = np.c_[
            np.log1p(n[:, 0]), np.log(n[:, 1] / n[:, 0]), np.log1p(100 * n[:, 2] / n[:, 1]),
            np.log1p(100 * n[:, 3] / n[:, 0]), np.log1p(100 * n[:, 4] / n[:, 0]),
        ]
        want = estimate(x, np.array([f for _, f in quality.FEATURES.values()]))
        got = np.array([found[k].distance for k in own])
        assert ((want > quality.CUTOFF) == (got > quality.CUTOFF)).all()
        assert np.median(np.abs(np.log((got + 0.1) / (want + 0.1)))) < 0.2


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(14)
    clean = [prose(rng, rng.randrange(60, 400), 3000) for _ in range(200)]
    # A phrase said twice is no outlier.
    clean += [" ".join([t, *t.split()[:3]]) for t in clean if len(t.split()) > 250][:5]
    words = [f"u{k}" for k in range(900)]
    bad = [
        prose(rng, 30_000, 30_000),
        " ".join("y" * 60 + str(k) for k in range(150)),
        " ".join(f"{w}$$$" for w in words[:100]),
        "\n".join(x for w in range(0, 150, 3) for x in (" ".join(words[w : w + 3]), "said")),
        " ".join(words[:120] + words[200:225] + words[120:150] + words[200:225]),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(clean + bad)], DOCS)
    found = {r.id: r for r in quality.verdicts(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [found[k].kept for k in range(len(found))] == [True] * len(clean) + [False] * len(bad)


def test_licenses(spark):
    more = [
        "x\nReleased under the MIT License.", "MIT\nlicense mit license", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "apache  LICENSE",
    ]
    docs = awkward(spark, more)
    got = {r.id: r for r in licenses.labelled(clashing(docs)).collect()}
    assert (got[11].labels, got[11].n_base, got[11].first_word, got[11].score) == ("mit", 1, 4, 1.0)
    assert (got[12].base_labels, got[12].n_base, got[12].first_word, got[12].last_word) == ("mit", 2, 0, 2)
    assert (got[13].base_labels, got[13].labels) == ("", "cc-by-nc-4.0")
    assert got[14].labels == "gpl,gpl-3.0" and got[15].labels == "apache" and got[15].score == 0
    assert got[0].labels == "" and got[0].first_word is None
    assert licenses.labelled(empty(spark)).count() == 0
    # Rows that share an id, null or not, have each their own labels.
    twins = [(k, t, None, None, 0) for k in (1, None) for t in ("Released under the MIT License", "plain words")]
    rows = licenses.labelled(spark.createDataFrame(twins, DOCS)).collect()
    assert sorted((r.id or 0, r.labels, r.score) for r in rows) == [(0, "", 0.0), (0, "mit", 1.0), (1, "", 0.0), (1, "mit", 1.0)]


def test_similarity_join_is_exact(spark):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(12)]
    templates = [rng.sample(words, rng.randrange(2, 8)) for _ in range(8)]
    templates = [(f"l{k}", " ".join(t[: k % 3]), " ".join(t)) for k, t in enumerate(templates)]
    texts = ["\n".join(" ".join(rng.choices(words + ["z"], k=rng.randrange(12))) for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    for threshold, runs in ((0.5, ((1, 1),)), (0.8, ((1, 1), (3, 2))), (1.0, ((2, 1),))):
        _, found = licenses.scan(docs, templates, licenses.PHRASES, threshold, runs)
        want = set()
        for d, t in enumerate(texts):
            split = t.split("\n")
            blocks = [" ".join(split[i : i + n]) for n, step in runs for i in range(0, len(split), step)]
            for b, block in enumerate(blocks):
                held = set(ALNUM.findall(low(block)))
                for k, (_, telling, template) in enumerate(templates):
                    parts = set(template.split())
                    if len(parts & held) >= math.ceil(threshold * len(parts) - 1e-9) and set(telling.split()) <= held:
                        want.add((d, b, k))
        rows = found.collect()
        assert len(rows) == len(want) and {(r.id, r.block, r.template) for r in rows} == want


def test_each_filter_prunes(spark):
    # Ten words, nine needed: a prefix of two. Ranks stand for words, rarest first.
    ranks = list(range(0, 20, 2))
    prefix = spark.createDataFrame(
        [(r, 0, "l", at, 9, ranks, []) for at, r in enumerate(ranks[:2])],
        "rank int, template int, label string, t_at int, needed int, t_ranks array<int>, telling array<int>",
    )
    blocks = {"late words only": ranks[2:], "short": [0, 2, 4], "second word late": [1, 2, *ranks[3:]], "fits": ranks[1:]}
    frame = spark.createDataFrame([(n, sorted(r)) for n, r in blocks.items()], "id string, ranks array<int>")
    met = [(r.id, r.long_enough, r.placed_early) for r in licenses._meetings(frame, prefix).collect()]
    assert {m[0] for m in met} == {"short", "second word late", "fits"}
    assert all(not long for n, long, _ in met if n == "short") and ("fits", True, True) in met
    assert [(long, early) for n, long, early in met if n == "second word late"] == [(True, False)]


def test_wrapped_and_changed_notices(spark):
    grant = next(t for label, _, t in licenses.TEMPLATES if label == "mit" and t.startswith("permission")).split()
    wrap = lambda words, n: "\n".join(" * " + " ".join(words[k : k + n]) for k in range(0, len(words), n))
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    changed = [w if w != "sell" else "vend" for w in grant]
    texts = {
        "bsd": f"int main\n{bsd}\nthe following", "mit": f"x\ny\nz\n{wrap(grant, 7)}\nend", "mit ": wrap(changed, 12),
        "gpl-3.0": "This work is licensed under the terms of the\nGNU General Public License,\nversion 3", "": wrap(grant[:30], 9),
        "proprietary": "All rights reserved.", "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    }
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts.values())], DOCS)
    got = {r.id: r for r in licenses.labelled(docs).collect()}
    for k, label in enumerate(texts):
        own = [x for x in got[k].labels.split(",") if x not in ("gpl", "apache")]
        assert own == ([label.strip()] if label else []) or own == [""] and not label, (label, got[k])
    assert 0.9 < got[2].score < 1.0 and got[1].score == 1.0


@pytest.fixture(scope="module")
def pieces():
    return lattice.load(PIECES)


def by_hand(word, index, byte_ids, weight):
    total, best = [1.0] + [0.0] * len(word), [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 40), end):
            kinds = [index[word[start:end]]] if word[start:end] in index else []
            kinds += [int(byte_ids[word[start]])] if end - start == 1 else []
            for k in kinds:
                total[end] += total[start] * math.exp(weight[k])
                option = (best[start][0] + weight[k], -(-best[start][1] + 1))
                best[end] = max(best[end], option) if best[end] else option
    return math.log(total[-1]), -best[-1][1]


@pytest.fixture(scope="module")
def index():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    skip = lambda k: m.is_byte(k) or m.is_control(k) or m.is_unknown(k) or m.get_score(k) < -40000
    return {m.id_to_piece(k).encode(): k for k in range(m.vocab_size()) if not skip(k)}


def test_lattice(pieces, index):
    p, weight = pieces
    rng = random.Random(2)
    parts = ["th", "e", "an", "ing", "q", "é", "日", "ß", "zz", "the"]
    words = sorted({("▁" + "".join(rng.choices(parts, k=rng.randint(1, 7)))).encode() for _ in range(150)} | {b"a", b"\xe2\x96\x81"})
    trie = lattice.build(words, p)
    total, (_, count) = lattice.forward(trie, weight)[trie.terminal], lattice.best(trie, weight)
    for k, word in enumerate(words):
        want = by_hand(word, index, p.byte_ids, weight)
        assert abs(total[k] - want[0]) < 1e-9 and count[trie.terminal[k]] == want[1]
    # Expected counts are the slope of the likelihood.
    n = np.array([rng.randint(1, 5) for _ in words], float)
    expected = lattice.expected_counts(trie, weight, n, p.count)
    for k in rng.sample(np.flatnonzero(expected > 1e-6).tolist(), 8):
        up, down = weight.copy(), weight.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = sum(s * (n * lattice.forward(trie, w)[trie.terminal]).sum() for s, w in ((1, up), (-1, down))) / 2e-5
        assert abs(slope - expected[k]) < 1e-4 * max(1, expected[k])


def test_token_counts(spark, pieces, index):
    p, weight = pieces
    docs = awkward(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = token_counts.token_counts(clashing(docs), PIECES).collect()
    assert len(found) == docs.count()
    for r in found:
        words = BLANK.findall(texts[r.id] or "")
        if len(words) < 1000:
            assert (r.n_words, r.n_tokens) == (len(words), sum(by_hand(("▁" + w).encode(), index, p.byte_ids, weight)[1] for w in words))
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


def test_language_model(spark):
    rng = random.Random(5)
    docs = awkward(spark, [prose(rng, 60, 30) for _ in range(40)])
    held = language_model.held_out_fold(F.col("doc_id"))
    rows = docs.withColumn("held", held).collect()
    train, ends = Counter(), 0
    for r in rows:
        if not r.held:
            train.update(BLANK.findall(low(r.text)))
            ends += 1
    total, distinct = sum(train.values()) + ends, len(train) + 1
    texts = {r.doc_id: r for r in rows}
    found = language_model.score(clashing(docs), held, PIECES).collect()
    assert len(found) == len(rows)
    for r in found:
        words = BLANK.findall(low(texts[r.id].text))
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (texts[r.id].held, len(words) + 1, total)
        assert r.n_known == 1 + sum(train[w] > 0 for w in words) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    # Fitting helps on texts that were not learned from.
    fresh = [sum(r.score for r in language_model.score(docs, held, PIECES, steps).collect() if r.held_out) for steps in (0, 2)]
    assert fresh[1] > fresh[0]
    assert language_model.score(empty(spark), held, PIECES).count() == 0
