import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiloom.llm import bpe

SPEC = bpe.spec()
MADE = bpe.Transducer(SPEC)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(bpe.path())


def same(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    got = b"".join(MADE.encode(text))
    assert got == b"".join(x.to_bytes(4, "little") for x in ids), text
    decoder = MADE.decoder()
    half = len(got) // 8 * 4
    assert decoder.feed(got[:half]) + decoder.feed(got[half:], last=True) == theirs.decode(ids, skip_special_tokens=False)


def test_texts(theirs):
    for text in ["", " ", "Hello, World's  best", "İstanbul ΣΟΣ naïve café", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x00z　w", "\U0001f600 日本語 12345", "it's they'll'd", "\ufeffa\u200bb", ":\U0003d000a", "\U00013460b"]:
        same(theirs, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text(theirs, text):
    same(theirs, text)


def test_long_words_and_pieces(theirs, monkeypatch):
    rnd = random.Random(5)
    for alphabet in ("ab", "the", "aeinorst", "!?.-", "éa"):
        same(theirs, "".join(rnd.choice(alphabet) for _ in range(60_000)))
    same(theirs, "e" * 50_000)
    text = " ".join(rnd.choice(["the", "Caté", "<|endoftext|>", "\n", "x1"]) for _ in range(3000))
    monkeypatch.setattr(bpe, "PIECE", 100)
    same(theirs, text)


def test_text_decoder():
    ids = b"".join(MADE.encode("Café 日本 ok"))
    decoder = bpe.Decoder(MADE, plain=False)
    out = "".join(decoder.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + decoder.feed(b"", True)
    assert out == "café 日本 ok "


def test_rows(spark, theirs):
    rows = [(1, "A b c", "x"), (2, None, "x"), (2, "", "y"), (None, "A b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode(docs, digests=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("2", 0), ("2", 0), ("None", 3)]
    assert {r.ids_sha256 for r in got if not r.n_tokens} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode(docs.where("false")).count() == 0


def test_every_word_goes_through_the_transducer(monkeypatch):
    # With the whole-word merge out of reach, all words still get their tokens; only pairs of tokens are merged.
    made = bpe.Transducer(SPEC)
    merged = made.merged
    longest = []
    monkeypatch.setattr(made, "merged", lambda ids: longest.append(len(ids)) or merged(ids))
    text = "The incomprehensibilities of antidisestablishmentarianism " + "abcdefgh" * 500
    assert b"".join(made.encode(text)) == b"".join(MADE.encode(text))
    assert longest and max(longest) <= 2 * made.longest


def test_state_stays_bounded(monkeypatch):
    # Stable tokens leave; what is held, and how far after a token it is decided, keep below the sufficient lookahead.
    rnd = random.Random(8)
    made = bpe.Transducer(SPEC)
    common_start = made.common_start
    held, late = [], []

    def watched(begins, base, end):
        stable = common_start(begins, base, end)
        held.append(len(begins))
        late.append(end - stable)
        return stable

    monkeypatch.setattr(made, "common_start", watched)
    for alphabet in ("e", "ab", "the", "aeinorst"):
        word = "".join(rnd.choice(alphabet) for _ in range(20_000)).encode()
        assert b"".join(x.to_bytes(4, "little") for x in made.word(word)) == b"".join(x.to_bytes(4, "little") for x in made.merged([made.inner[b] for b in word[:-1]] + [made.final[word[-1]]]))
    assert held and max(late) <= made.lookahead and max(held) <= made.lookahead + bpe.STEP + made.longest


def test_long_texts_leave_early(spark, monkeypatch):
    monkeypatch.setattr(bpe, "OUT", 1 << 16)
    rows = [(k, "word " * (20_000 if k % 7 == 0 else 3)) for k in range(40)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(k, 20_000 if k % 7 == 0 else 3) for k in range(40)]
