"""Words of the byte-pair encoder: the spelled-out pattern, the memory of words, decoding."""

import public_tokenizers
import regex
import tokenizers

from wavelane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_spelled_out_pattern_splits_as_the_library_pattern():
    v = bpe.load(PATH)
    assert not isinstance(v.plain_words, type(regex.compile("")))
    usual = [c for c in map(chr, range(0x20AD)) if not bpe.RARE.match(c)]
    for c in usual:
        text = f"a{c}b {c}{c} 7{c}'s'{c}t"
        assert v.plain_words.findall(text) == v.words.findall(text), hex(ord(c))


def test_ids_are_those_of_the_library_where_lower_case_or_composing_brings_rare_letters():
    texts = ["Ⱥb Ⱦ", "ạ x", "x\x1cy\x85z\xa0w", "İ can't <|endoftext|>  end", "", "ß€†"]
    ids, bounds = bpe.Encoder(bpe.load(PATH)).encode(texts)
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_is_encoded_once_over_many_slices(monkeypatch):
    asked, encode_words = [], bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda v, words: asked.extend(words) or encode_words(v, words))
    encoder = bpe.Encoder(bpe.load(PATH))
    letters = [chr(97 + k) for k in range(26)]
    words = [a + b + c + d for a in letters[:13] for b in letters for c in letters for d in letters[:15]]
    assert len(words) > 130_000
    for _ in range(2):
        for k in range(0, len(words), 20_000):
            encoder.encode([" ".join(words[k : k + 20_000])])
    assert len(asked) == len(words)


def test_null_and_empty_ids_decode_to_an_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 269]), (4, None)], "id bigint, ids array<int>")
    tokens = bpe.load(PATH).tokens
    found = {r.id: r.text for r in bpe.decode(rows, PATH).collect()}
    assert found == {1: "", 2: "", 3: f"{tokens[320]} {tokens[269]}", 4: ""}
