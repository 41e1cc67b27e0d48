"""Decontamination, substring removal, SimHash and line dedup against brute force."""

import random
import tracemalloc

import numpy as np
import xxhash

from tests.llm.helpers import ALNUM, BLANK, DOCS, Sets, awkward, clashing, empty, low, prose
from wavelane.llm import decontaminate, lines, simhash, substrings


def test_suffix_order_and_fm_index():
    rng = np.random.default_rng(0)
    for k in range(30):
        text = np.append(rng.integers(1, 2 + k % 5, int(rng.integers(1, 200))), 0)
        order = decontaminate.suffix_order(text, 3)
        whole = text.tolist()
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
        index = decontaminate.FMIndex(text, 3)
        assert index.locate(np.arange(len(text))).tolist() == order.tolist()


def hits(texts, items, size):
    phrases = {}
    for item, text in items:
        words = ALNUM.findall(low(text))
        for k in range(max(1, len(words) - size + 1)) if words else ():
            phrases.setdefault(tuple(words[k : k + size]), set()).add(item)
    out = []
    for text in texts:
        words, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                if (p := tuple(words[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[p]
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(60), 5) for _ in range(15)]
    docs = awkward(spark, texts)
    items = [("a", prose(rng, 7, 5)), ("b", "W1, w2!"), ("c", None), ("d", ""), ("e", "w1 w2"), (None, prose(rng, 6, 5))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = docs.select("text").collect()
    want = sorted(hits([r.text for r in rows], [(i or "", t) for i, t in items], 4))
    for block_words in (decontaminate.BLOCK_WORDS, 5):
        found = decontaminate.occurrences(clashing(docs), bench, 4, block_words=block_words).collect()
        assert sorted((r.n_words, sum(e - s for s, e in r.spans), r["items"]) for r in found) == want
    clean = decontaminate.cleaned(clashing(docs), bench, 4)
    assert clean.schema == clashing(docs).schema and clean.count() == docs.count()
    assert decontaminate.cleaned(empty(spark), bench).count() == 0
    assert all(not r.spans for r in decontaminate.occurrences(docs, bench.limit(0), 4).collect())


def test_long_items_are_cut_with_an_overlap(spark, monkeypatch):
    """Every window of an item of many pieces is found, whichever block and piece it lies in; extra columns do not matter."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    rng = random.Random(4)
    long = prose(rng, 100, 10_000).split()
    texts = [" ".join(["x", *long[k : k + 4], "y"]) for k in range(97)] + [" ".join(long), " ".join(long[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(long))], "item_id string, text string")
    want = hits(texts, [("a", " ".join(long)), ("b", " ".join(long))], 4)
    for block_words in (1000, 20):
        found = decontaminate.occurrences(docs, clashing(bench), 4, block_words=block_words).orderBy("id").collect()
        assert [(r.n_words, sum(e - s for s, e in r.spans), r["items"]) for r in found] == want
    files = decontaminate._phrase_blocks(bench, "item_id", 4, 20)
    assert len(files) > 10


def test_decontamination_cuts_text():
    text = "Über, one TWO three! four".encode()
    assert decontaminate.without_spans(text, [(1, 3)]).decode() == "Über,  three! four"


def test_enhanced_suffix_array():
    rng = random.Random(5)
    for _ in range(20):
        runs = [bytes(rng.choices(b"ab\x00", k=rng.randint(5, 40))) for _ in range(rng.randint(1, 8))]
        size = np.array([len(r) for r in runs])
        begin = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()) + 7, np.int64)
        for b, r in zip(begin, runs):
            text[b : b + len(r)] = np.frombuffer(r, np.uint8).astype(int) + 1
        starts = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, size)])
        order, common = substrings.enhanced_suffix_array(text, starts, np.repeat(begin + size, size))
        ends = np.repeat(begin + size, size)
        suffixes = [text[starts[i] : ends[i]].tolist() for i in order]
        assert suffixes == sorted(suffixes)
        shared = [0]
        for a, b in zip(suffixes, suffixes[1:]):
            shared.append(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
        assert common.tolist() == shared


def repeats(docs, size):
    least = {}
    for d, x in docs:
        for k in range(len(x) - size + 1):
            w = x[k : k + size]
            least[w] = min(least.get(w, d), d)
    out = {}
    for d, x in docs:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - size + 1):
            if least[x[k : k + size]] < d:
                gone[k : k + size] = True
        out[d] = np.frombuffer(x, np.uint8)[~gone].tobytes()
    return out


def test_runs_that_differ_in_high_hash_bits_only():
    anchor, whole = np.array([5, 5], np.uint64), np.array([1, 1 | 1 << 50], np.uint64)
    columns = anchor, whole, np.array([1, 2]), np.array([0, 0]), np.array([1, 1])
    blob = substrings._pack(columns, substrings._RUN_TYPES)
    spans = [substrings._unpack([b], substrings._SPAN_TYPES) for _, b in substrings._equal_runs([blob], 3, 1)]
    # Both are asked for their bytes, none is cut.
    assert [s[3].tolist() for s in spans] == [[3, 3]]


def test_one_anchor_under_many_runs():
    """20 000 texts share the edge of a passage: sorted in passes the result is the same, in far less memory."""
    rng = random.Random(8)
    edge = bytes(rng.choices(b"abcdefgh", k=60))
    bodies = [edge + bytes(rng.choices(b"abcdefgh", k=20)) for _ in range(20_000)]
    bodies[7] = bodies[3]
    head = np.array([[k, 0, 80] for k in range(len(bodies))], np.int64).T
    blob = np.int64(len(bodies)).tobytes() + np.ascontiguousarray(head).tobytes() + b"".join(bodies)

    def spans(most):
        tracemalloc.start()
        blobs = [b for _, b in substrings._different_runs([blob], 50, 1, most)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        columns = substrings._unpack(blobs, substrings._SPAN_TYPES)
        return sorted(zip(*(c.tolist() for c in columns))), peak

    (whole, much), (dealt, little) = spans(1 << 30), spans(1 << 15)
    assert whole == dealt and {d for d, *_ in whole} == set(range(1, len(bodies)))
    assert little < much / 2 and little < 2_500 * len(bodies), (little, much)


def test_copies_in_a_slice_send_one_run():
    anchor, whole = np.array([1, 1, 1, 2], np.uint64), np.array([5, 5, 6, 5], np.uint64)
    assert substrings._later_in_slice(anchor, whole, np.array([9, 4, 8, 9])).tolist() == [True, False, False, False]
    assert substrings._later_in_slice(anchor[:0], whole[:0], np.zeros(0, np.int64)).tolist() == []


def test_substrings(spark):
    rng = random.Random(3)
    pool = [bytes(rng.choices(b"abc \x00", k=rng.randint(5, 60))).decode() for _ in range(6)]
    more = ["".join(rng.choice(pool)[rng.randrange(4) :] for _ in range(rng.randrange(7))) for _ in range(40)]
    docs = awkward(spark, [*more, "a" * 700, "a" * 300, "b" + "a" * 90])
    want = repeats([(r.doc_id, (r.text or "").encode()) for r in docs.filter("doc_id is not null").collect()], 12)
    for r in substrings.without_repeats(clashing(docs), 12, 5).collect():
        if r.id is not None:
            assert bytes(r.kept) == want[r.id]
        else:
            assert r.starts == [] and r.n_bytes == len(r.kept)
    assert substrings.without_repeats(empty(spark)).count() == 0


def fingerprint(text, width):
    words = BLANK.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    docs = awkward(spark, ["a b c", "a b c d", "A  b\tc d", "", None])
    rows = docs.collect()
    sets = Sets({r.doc_id for r in rows if r.doc_id is not None})
    prints = [(r.doc_id, fingerprint(r.text, 4)) for r in rows if r.doc_id is not None]
    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= 4:
                sets.join(a, b)
    found = simhash.near_duplicates(clashing(docs), 4, 4).collect()
    assert len(found) == len(rows)
    assert {(r.id, r.fp % 2**64) for r in found} == {(r.doc_id, fingerprint(r.text, 4)) for r in rows}
    assert all(r.component == (None if r.id is None else sets.find(r.id)) for r in found)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def near_groups(prints, bits):
    sets = Sets(range(len(prints)))
    for a, x in enumerate(prints):
        for b in range(a):
            if (x ^ prints[b]).bit_count() <= bits:
                sets.join(a, b)
    return [sets.find(k) for k in range(len(prints))]


def test_links_lose_nothing(spark):
    """Dense and sparse fingerprints, hot buckets cut again, more blocks than needed."""
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = set()
    for _ in range(500):
        x = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x, k) for k, x in enumerate(prints)], "fp bigint, v bigint")
    for bits, agree, hot in ((4, 1, 4096), (4, 1, 20), (6, 2, 30)):
        sets = Sets(range(len(prints)))
        for r in simhash.links(frame, bits, agree, hot).collect():
            sets.join(r.a, r.b)
        assert [sets.find(k) for k in range(len(prints))] == near_groups(prints, bits)


def test_near_duplicates_go_once(spark):
    rng = random.Random(2)
    base = prose(rng, 300).split()
    near = [*base]
    near[150] = "other"
    docs = awkward(spark, [" ".join(base), " ".join(near), " ".join(base), prose(rng, 300)])
    rows = {r.doc_id for r in simhash.deduplicated(clashing(docs)).select("doc_id").collect()}
    assert {11, 14} <= rows and not {12, 13} & rows and None in rows
    assert simhash.deduplicated(docs).schema == docs.schema
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_near_duplicates_behind_relatives(spark):
    """Pairs at 0.8 whose smallest candidates are relatives at about 0.7."""
    rng = random.Random(12)

    def changed(words, n):
        out = [*words]
        for k in rng.sample(range(len(out)), n):
            out[k] = f"x{rng.randrange(10**9)}"
        return out

    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    texts = []
    for _ in range(5):
        base = prose(rng, 300, 10**6).split()
        texts += [changed(base, 7) for _ in range(20)]
        x = changed(base, 7)
        texts += [x, changed(x, 4), changed(x, 6), changed(x, 7)]
    sets, own = Sets(range(len(texts))), [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                sets.join(a, b)
    want = {k for k in range(len(texts)) if sets.find(k) == k}
    docs = spark.createDataFrame([(k, " ".join(t), None, None, None) for k, t in enumerate(texts)], DOCS)
    # So wide a radius that all of a family are candidates.
    found = {r.doc_id for r in simhash.deduplicated(docs, max_bits=20, agree=1).select("doc_id").collect()}
    assert len(want) < len(texts) and found == want


def without_repeated_lines(docs):
    """Lines of all pairs of neighbouring lines with words that stand earlier, cut out."""
    seen, gone = set(), {}
    for d, text in sorted(docs):
        split = (text or "").split("\n")
        worded = [i for i, line in enumerate(split) if BLANK.search(line)]
        gone[d] = set()
        for i, j in zip(worded, worded[1:]):
            if (split[i], split[j]) in seen:
                gone[d] |= set(range(i, j + 1))
            seen.add((split[i], split[j]))
    return {d: "\n".join(s for i, s in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in docs}, gone


def test_repeated_lines(spark):
    rng = random.Random(4)
    pool = [prose(rng, 8) for _ in range(40)]
    more = []
    for _ in range(60):
        parts = [[prose(rng, 6)] * rng.randrange(2) for _ in range(3)]
        for part in parts:
            a = rng.randrange(40)
            part += pool[a : a + rng.choice([1, 2, 2, 3, 8, 20])] + [""] * rng.randrange(2)
        more.append("\n".join(line for part in parts for line in part))
    docs = awkward(spark, [*more, "a\na\na\n \na", "a\n\n\na\nb", "\n\n"])
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want, gone = without_repeated_lines([(r.doc_id, r.text) for r in docs.collect()])
    report = {r.id: r for r in lines.report(clashing(docs)).collect()}
    assert {d: r.text or "" for d, r in report.items()} == want
    for r in docs.collect():
        spans = sum(i - 1 not in gone[r.doc_id] for i in gone[r.doc_id])
        counts = report[r.doc_id][1:4]
        assert counts == ((r.text or "").count("\n") + 1, len(gone[r.doc_id]), spans)
    # Most of what goes is found as chunks.
    scanned = lines._units(lines._with_lines(docs.filter("text is not null"), docs.text))
    assert scanned.selectExpr("sum(size(_chunks)) n").first().n > 100
    assert lines.deduplicated(clashing(docs)).schema == clashing(docs).schema
    assert lines.deduplicated(empty(spark)).count() == 0
    repeated = awkward(spark)
    kept = {r.doc_id: r.text for r in lines.deduplicated(repeated.filter("doc_id <> 5 or doc_id is null")).collect()}
    assert kept[None] == repeated.filter("doc_id is null").first().text
