import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casefile.llm import bpe, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.tokenizer(PATH), Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "a'S it's 'RE", "x" * 7000, "ab" * 5000 + "é" * 900, "ΑΣ ΟΔΟΣ İI", "é" * 4000, "한국어" * 2000, "한" * 900, "!'" * 3000 + "s", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>" * 90, "日本語" * 3000, "\x1c\x1d a b\x85c", "1234 ½ ²³", "🙂👩‍👩‍👧" * 900, "the " * 4000, "a" * 6553 + "'" + "s b", "\n".join("x'll" * 99 for _ in range(40)), "é" * 50, "a b　c", "Å ﬁ ǅ"]
    return texts + ["".join(rng.choice("abcdefgh'st ") for _ in range(rng.choice([5, 300, 7000]))) for _ in range(40)]


@pytest.mark.parametrize("part", [7, 1000, 1 << 16])
def test_equals_the_library(both, monkeypatch, part):
    tok, ref = both
    monkeypatch.setattr(bpe, "PART", part)
    for text in odd_texts():
        want = ref.encode(text, add_special_tokens=False).ids
        got = bpe.encode_text(tok, text)
        assert got == want, text[:30]
        assert bpe.decode_ids(tok, got, names=True) == ref.decode(want, skip_special_tokens=False)


def test_memory_is_bounded(both):
    tok, ref = both
    text = "abc" * 60_000
    enc, out, most = bpe.Encoder(tok), [], 0
    for i in range(0, len(text), 500):
        out += enc.feed(text[i : i + 500])
        most = max(most, len(enc.raw) + len(enc.text))
    assert out + enc.finish() == ref.encode(text, add_special_tokens=False).ids
    assert most < 10 * (bpe.WINDOW + tok.lookahead)


def test_cache_forgets_what_does_not_come_again(both, monkeypatch):
    _, ref = both
    tok, merged = bpe.Tokenizer(PATH), []
    monkeypatch.setattr(bpe, "CACHE", 20_000)
    monkeypatch.setattr(tok, "_word", lambda w: merged.append(w) or bpe.Tokenizer._word(tok, w))
    for i in range(0, 200_000, 1000):
        text = " ".join(f"often q{'abcdefghij'[k % 10]}{k:x}" for k in range(i, i + 1000))
        got = bpe.encode_text(tok, text)
        assert i % 50_000 or got == ref.encode(text, add_special_tokens=False).ids
    assert len(tok.cache) + len(tok.older) <= 40_000
    assert merged.count("often") == 1


def test_tokenizer_goes_with_the_next_operator():
    tok = bpe.tokenizer(PATH)
    assert bpe.tokenizer(PATH) is tok
    list(toxicity._count(iter([])))
    assert bpe.tokenizer(PATH) is not tok and bpe.encode_text(bpe.tokenizer(PATH), "Hello") == bpe.encode_text(tok, "Hello")


def test_words_come_back(both):
    tok, _ = both
    assert bpe.decode_ids(tok, bpe.encode_text(tok, "Hello, WORLD! 🙂 déjà")) == "hello , world ! 🙂 déjà "


def test_query(spark, both):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "The cat", 0), (3, "The cat", 0)], "doc_id long, text string, ids int")
    out = bpe.encode_and_decode(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids", "_ids", "decoded"]
    _, ref = both
    for r in out.collect():
        want = ref.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["_ids"]) == want and r["decoded"] == ref.decode(want, skip_special_tokens=False)
    assert bpe.encode_and_decode(docs.limit(0), PATH).count() == 0
