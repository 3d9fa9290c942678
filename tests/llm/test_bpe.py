"""Byte-pair encoding against the tokenizers library, and its lookahead against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from guardframe.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)
VOCABULARY = bpe.Vocabulary.load()
TEXTS = [
    "", " ", "  ", "hello world", "It's they're I'll '", "'r", "a'", " \n\n x", "x  \t", "naïve 漢字かな 🙂🙂", "1234 ½ ٣", "<|endoftext|>", "a <|endoftext|>  b<|endoftext", "<|endoftext|><|endoftext|>",
    "\x00\x1c\x1d\x85   x", "՘₏ x՘y", "a" * 5000, " " * 5000 + "x", "漢字" * 3000, "-" * 7000 + "a", "=" * 4097 + "\n", "ab" * 4000 + " 1" * 50, "\n" * 4100, "1" * 9000,
]


def pushed(text, sizes, block):
    encoder, out, at = bpe.Encoder(VOCABULARY, block), [], 0
    while at < len(text):
        n = next(sizes)
        out.append(encoder.push(text[at : at + n]))
        at += n
    return np.frombuffer(b"".join([*out, encoder.finish()]), "<i4").tolist()


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["'", "'re", "'ll", " ", "  ", "\n", "\t", "a", "the", "漢", "é", "1", "22", "!", "--", "<|endof", "text|>", "<|endoftext|>", " ", "՘", "🙂", "s", "t"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    encoder = bpe.Encoder(VOCABULARY)
    for text in [*TEXTS, *odd_texts(1, 2000)]:
        assert encoder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text[:80]


def test_texts_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    texts = [*(t for t in TEXTS if len(t) < 300), *odd_texts(9, 300)]
    assert [x.tolist() for x in bpe.Encoder(VOCABULARY).encode_all(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_any_size_and_any_block_give_the_same_ids():
    rng = random.Random(2)
    for text in [*TEXTS, *odd_texts(3, 400)]:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        for low, high, block in ((1, 1, 4), (1, 3, 4), (1, 40, 16), (1000, 3000, 64)):
            if len(text) / high < 6000:
                assert pushed(text, iter(lambda: rng.randint(low, high), None), block) == want, (text[:80], block)


def test_every_character_is_cut_as_the_library_cuts_it():
    scanner, split = bpe.Scanner(VOCABULARY), LIBRARY.pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4000):
        text = "".join(f"a{c}a1{c}!" for c in chars[at : at + 4000])
        assert len(scanner.words(text)) == len(split(text)), at


def test_memory_does_not_grow_with_the_text():
    encoder, most = bpe.Encoder(VOCABULARY), 0
    for _ in range(300):
        encoder.push("ab" * 1000)
        most = max(most, len(encoder.open) + len(encoder.rest) + len(encoder.held))
    assert most < bpe.BLOCK + VOCABULARY.lookahead + 5000


def random_vocabulary(rng, letters, n):
    """A small proper merge list over a few bytes."""
    names = {b: c for c, b in bpe.byte_alphabet().items()}
    vocab = {names[b]: b for b in range(256)}
    tokens, merges = [names[ord(c)] for c in letters], []
    for _ in range(4 * n):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in vocab and len(a + b) < 12:
            vocab[a + b] = len(vocab)
            tokens.append(a + b)
            merges.append([a, b])
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    return bpe.Vocabulary(spec)


def test_tokens_before_the_lookahead_are_stable():
    rng = random.Random(4)
    tight = 0
    for _ in range(120):
        v = random_vocabulary(rng, "abc"[: rng.randint(1, 3)], rng.randint(1, 14))
        for _ in range(60):
            known = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            more = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
            whole, place = [], 0
            for t in v.merge(known + more):
                place += len(v.bytes[t])
                whole.append((place, t))
            place = 0
            for k, t in enumerate(v.merge(known)):
                place += len(v.bytes[t])
                if place <= len(known) - v.lookahead:
                    assert whole[k] == (place, t)
                elif whole[k] != (place, t):
                    tight += 1
                    break
    assert tight > 100
    assert VOCABULARY.lookahead > 0


def test_long_and_short_merges_agree():
    rng = random.Random(5)
    for _ in range(300):
        v = random_vocabulary(rng, "ab", 10)
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
        assert v.merge(data) == v._merge_long([v.byte[b] for b in data])
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 70))) for _ in range(20)]
        assert [np.frombuffer(p, "<i4").tolist() for p in v.merge_all([*pieces, b""])] == [*map(v.merge, pieces), []]


def test_decoding_is_that_of_the_library():
    rng = random.Random(6)
    decoder = bpe.Decoder(VOCABULARY)
    for text in TEXTS:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert decoder.decode(np.array(ids, np.int32)) == text
    for _ in range(2000):  # most of these are no UTF-8
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257), 60000]) for _ in range(rng.randint(0, 12))]
        want = LIBRARY.decode(ids, skip_special_tokens=False)
        assert decoder.decode(np.array(ids, np.int32)) == want
        assert "".join([*(decoder.push([i]) for i in ids), decoder.finish()]) == want


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}])
def test_other_files_are_refused(change):
    spec = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    with pytest.raises(ValueError):
        bpe.Vocabulary(spec | change)


def test_rows(spark, tmp_path):
    rows = [(k, t, 1, "x") for k, t in enumerate(TEXTS)] + [(None, None, 2, "y"), (0, "again", 2, "y"), (0, "again", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = bpe.decode_ids(bpe.encode_texts(df)).collect()
    want = sorted((i is None, i or 0, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.text) for r in got) == want
    assert bpe.decode_ids(bpe.encode_texts(df.limit(0))).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted(tuple(r)[1:] for r in bpe.op13_bpe_codec(spark, str(tmp_path)).collect())
    assert found == sorted((len(ids), sha(",".join(map(str, ids))), sha(t)) for _, _, ids, t in want)
