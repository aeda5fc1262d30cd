import hashlib
import random
import time

import public_tokenizers
import sentencepiece
import numpy as np

from tessella.llm import pieces, queries

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "ß", "漢", "😀", "\x00", "​", "1", "99", "the", "ing", "<s>", "</s>", "<0x41>", "<unk>", "\r\n", "...", "=" * 40, "abab" * 9, "́"]


def check(got, texts):
    for (ids, raw), text in zip(got, texts):
        want = SP.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert raw.decode() == SP.decode(want)


def test_equals_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(30))) for _ in range(4000)] + [None, "", " ", "▁", "\n", "a" * 5000, "the " * 3000, " x ", "x"]
    check(pieces.codec(pieces.default_model()).run(texts), texts)


def test_long_unbroken_words():
    rng = random.Random(8)
    lower = "abcdefghijklmnopqrstuvwxyz"
    english = "the of and to in that which from were been also other language information processing although".split()
    texts = [
        "".join(rng.choices(lower, k=1_000_000)),
        "".join(rng.choices(lower + lower.upper() + "0123456789+/", k=1_000_000)),
        "".join(rng.choices(english, k=100_000)),
        "the" * 100_000,
        "a" * 300_001,
        "".join(rng.choices("漢字仮名交文章的了是", k=200_000)),
    ]
    texts += ["".join(rng.choices(["ab", "a", "the", "ing", "é", "\u0301", "😀", "="], k=rng.randrange(300, 900))) for _ in range(60)]
    start = time.perf_counter()
    got = pieces.codec(pieces.default_model()).run(texts)
    assert time.perf_counter() - start < 60
    check(got, texts)


def test_query_over_documents(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = SP.encode(text or "", add_bos=True, add_eos=True)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, nothing):
    got = pieces.encode(odd, pieces.default_model())
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {tuple(r.ids) for r in rows if r.doc_id in (1, 2)} == {(1, 2)}
    back = pieces.decode(got.drop("decoded"), pieces.default_model()).collect()
    want = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert {(r.doc_id, r.decoded) for r in back} == want == {(r.doc_id, r.decoded) for r in rows}
    assert pieces.encode(nothing, pieces.default_model()).count() == 0
