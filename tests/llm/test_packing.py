import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from msgaudit.llm import packing

from .helpers import documents, frame, small


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_runs_equal_best_fit_decreasing():
    for seed in range(40):
        rnd = random.Random(seed)
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(0, 500))]
        intervals, number = packing.match_runs(Counter(lengths), 64)
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits, key=lambda k: gaps[k])] -= n
            else:
                gaps.append(64 - n)
        assert number == len(gaps)


def check(rows, out, tokenizer):
    ids = defaultdict(list)
    for doc, text in rows:
        ids[doc].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    want = Counter((doc, k // 2048, k, len(a[k:k + 2048]), zlib.crc32(a[k:k + 2048].tobytes()))
                   for doc, all_ids in ids.items() for a in all_ids for k in range(0, len(a), 2048))
    assert want == Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(sequences) <= max(1, -(-total // 2048) * 1.02 + 1)


def test_documents(spark, tokenizer):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    check(rows, packing.pack(small(spark, rows)).collect(), tokenizer)


def test_awkward_rows(spark, tokenizer):
    df = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    check(rows, packing.pack(df).collect(), tokenizer)
    assert packing.pack(frame(spark, [])).count() == 0


def test_words_give_the_ids_of_the_text(tokenizer):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["It's 12.5%, isn't it?! été ÉTÉ H̱ İ ΣΑΣ", "a\x1cb \x1f c", "a b c　d\x85e", "...x... x.,y ,. '",
             "<|endoftext|> a<|startoftext|>b.", "̀abc ̀", "日本語。テスト！ 한국어", "x٣٤. ½! Ⅷ?", "DON'T we'LL.", "", " \n\t "]
    rnd = random.Random(1)
    alphabet = "aB1 .,!?'é́ß\n-日% "
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(20_000)]
    texts += ["i̇.", "İ.", "xİ.. İ", "İ̇.", "ŉ. ǰ. ΐ."]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_leave_a_full_cache_and_come_back(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    encoder, rnd = packing.WordEncoder(packing.tokenizer_path()), random.Random(5)
    for _ in range(60):
        texts = [" ".join(f"word{rnd.choice('abcdefghijklm')}{rnd.randrange(9)}{rnd.choice(['', '.', '?!'])}" for _ in range(8))
                 for _ in range(3)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(e, "<u4").tolist() for e in encoder.encode_all(texts)] == want
        assert len(encoder.known) <= 40 + 2 * 24


def test_words_share_one_text_and_keep_their_ids(tokenizer):
    encoder = packing.WordEncoder(packing.tokenizer_path())
    assert encoder.plain is not None
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 14))) for _ in range(300)}
                   | {"don't", "x1y2", "straße", "naïve", "<|endoftext|>", "a.b", "...", "İx", "\U0001f600", "it's", "éa"})
    encoder._ids(words)
    for w in words:
        assert encoder.known[w] == np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w
    other = Tokenizer.from_file(packing.tokenizer_path())
    assert not packing._leaves_letters({"normalizer": None, "pre_tokenizer": None})
    assert other.get_vocab_size() == tokenizer.get_vocab_size()


def test_latin_letters_and_marks_need_the_bare_model_alone(tokenizer, monkeypatch):
    encoder, general = packing.WordEncoder(packing.tokenizer_path()), []
    ids_of = encoder._ids_of
    monkeypatch.setattr(encoder, "_ids_of", lambda tok, words, *shown: (general.extend(words) if tok is encoder.words else None,
                                                                        ids_of(tok, words, *shown)))
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) + rnd.choice(["", ".", "***", "&&&", "$$$,", ")", '."']) for _ in range(400)]
    for word, ids in zip(words, encoder.encode_all(words)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, word
    assert not [w for w in general if w[0].isalpha()]
