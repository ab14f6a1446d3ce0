import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from squelch.llm import codes, queries, tokens
from squelch.llm.queries import tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 7, 255, 256, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32)
    ids[rng.random(n) < 0.5] = 3
    opened = codes.Codes.open(codes.pack_ids(ids))
    assert (opened.span(0, n) == ids).all()
    for i in rng.integers(0, n, 50) if n else []:
        assert opened.at(int(i)) == ids[i]
        j = int(rng.integers(i, n + 1))
        assert (opened.span(int(i), j) == ids[i:j]).all()
    with pytest.raises(IndexError):
        opened.at(n)
    with pytest.raises(ValueError):
        codes.Codes.open(b"none")


ALPHABET = list("abcXYZ019 .,!?'\"()|#\n\t") + ["  ", "\r\n", "é", "ß", "नम", "한", " ", " ", "\x0b", "", "<|endoftext|>", "<|startoftext|>", "n't", " the", "\U0001f600", "İ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(8)
    path = tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    texts = ["", " ", "\n", "plain words, here.", "a <|endoftext|> b", "x<|startoftext|>", "<|ENDOFTEXT|>"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, tokens.Encoder(path).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_starts_anew_and_forgets_long_words():
    rng = random.Random(2)
    path = tokenizer_path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path, 50)
    for _ in range(20):
        texts = [" ".join(f"{rng.choice('abcd')}{rng.choice(['ing,', 'er', 'ly.', 'x' * 100])}" for _ in range(30)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]
        assert all(len(x) <= tokens.LONGEST for x in enc.memory)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_share_strings_and_old_ones_are_not_learned_again(name):
    rng = random.Random(5)
    path = tokenizer_path(name)
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path, 4000)
    sent = []

    class Counting:
        def __getattr__(self, method, inner=enc.units):
            return getattr(inner, method)

        def encode_batch_fast(self, batch, inner=enc.units, **more):
            sent.append(len(batch[0]))
            return inner.encode_batch_fast(batch, **more)

    enc.units = Counting()
    common = ["Über", "the", "ÿes", "a"]
    made = ["".join(rng.choice("aeßéstKLmn") for _ in range(rng.randint(3, 12))) for _ in range(12_000)]
    texts = ["\n".join(f"{w}{rng.choice(['', ',', '.', '...', ';x', '!?'])} {rng.choice(common)}" for w in made[k : k + 500]) for k in range(0, 12_000, 500)]
    for text in texts:
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert sum(sent) < 12_000 / 20  # a string of the merges' input for many words
    assert len(enc.memory) + len(enc.older) < 8000
    learned = []
    enc.learn = learned.extend
    enc.encode(texts[-1:])
    assert not learned


def test_each_cut_is_looked_up_once_a_batch():
    rng = random.Random(6)
    path = tokenizer_path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    looked = []

    class Counting(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    enc.memory = Counting()
    some = ["the", "Über", "ciudad,", "in***", "mañana.\n", "«été»", "it's", "4.5", "(und)", "a\tb", "x\r\n"]
    texts = [" ".join(rng.choices(some, k=500)) for _ in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(looked) < 200  # 20,000 words, some 40 cuts


PLACES = [*" \t\r\n", *string.punctuation, *"aZ7éÿ×÷İɏɐ²٣«’\u0301\xa0\u3000\x85\x1c", "'s", "<|endoftext|>"]


def test_cuts_in_bytes_equal_the_library():
    """Every two of these next to each other, at the begin, in the midst and at the end of texts that share a buffer."""
    path = tokenizer_path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = [form.format(x + y) for x in PLACES for y in PLACES for form in ("{}", "é{}n", " {} t", "")]
    column = pa.array(["zé.", *texts, "q"]).slice(1, len(texts))
    ids, counts = enc.encode_column(column)
    ends = np.cumsum(counts)
    for text, begin, end, whole in zip(texts, ends - counts, ends, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[begin:end].tolist() == whole.ids, repr(text)


def test_dropped_white_space_cuts_equal_the_library():
    """Also marks that compose with a small letter only, and the begins of contractions and special tokens."""
    path = tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    places = [*PLACES, *"HTJ\u0331\u0308\u030c\u0307\u0338İȺΣ", "'LL", "<|ENDOFTEXT|>", "<|", "|>", "The"]
    texts = [form.format(x + y) for x in places for y in places for form in ("{}", "é{}n", " {} T", "A{}S", "")]
    column = pa.array(["zÉ.", *texts, "q"]).slice(1, len(texts))
    for text, ids, whole in zip(texts, enc.encode(column), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.ids, repr(text)


def test_words_of_dropped_white_space_are_numbered_by_arrow():
    rng = random.Random(7)
    path = tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path, 5)
    looked, merged = [], []

    class Counting(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    class Merges:
        def __getattr__(self, method, inner=enc.units):
            return getattr(inner, method)

        def encode_batch_fast(self, batch, inner=enc.units, **more):
            merged.extend(batch[0])
            return inner.encode_batch_fast(batch, **more)

    enc.memory, enc.units = Counting(), Merges()
    some = ["the", "The", "the,", "(THE", "ciudad", "Ciudad.\n", "...ciudad", "mañana", "it's", "x" * 100]
    for size in (40, 1):
        texts = [" ".join(rng.choices(some, k=500)) for _ in range(size)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(x, add_special_tokens=False).ids for x in texts]
    assert not any(looked.count(x) > 2 for x in looked)  # 20,500 words, a dozen cuts
    assert "".join(merged).count("ciuda") == 1  # the frequent ones stay, whatever their capitals and marks
    assert len(enc.known) <= 5 and "x" * 100 not in enc.known.to_pylist()


def test_written_files_read_back(spark, odd, empty, odd_rows):
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = codes.read_digests(codes.write_tokens(odd, path, 0)).collect()
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x))
    texts = {r[0]: r[1] for r in odd_rows}
    at = 0
    for r in order:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert codes.read_digests(codes.write_tokens(empty, path, 0)).count() == 0


def test_payloads_are_read_before_the_join(odd):
    path = tokenizer_path("byte_bpe_50k.json")
    plan = codes.read_digests(codes.write_tokens(odd, path, 0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # below the join, so it moves digests only


def test_registered_query(spark, sf):
    rows = sorted(queries.QUERIES["op4_token_codes"](spark, sf).collect(), key=lambda r: r.doc_id)
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist()
