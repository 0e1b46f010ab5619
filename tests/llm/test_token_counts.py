import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import token_counts
from lamina.llm.token_counts import Encoder, count_tokens, resynchronised

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encode():
    return Encoder(FILE)


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library_on_edge_rows(edge, edge_rows, empty, library):
    got = count_tokens(edge, FILE, chunk=512, overlap=192, edge=32).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()), plain(library, t), plain(library, t) > 2048) for d, t, *_ in edge_rows
    )
    assert sum(r.n_seams for r in got) > 100 and count_tokens(empty, FILE).count() == 0
    with pytest.raises(ValueError):
        count_tokens(edge, FILE, chunk=512, overlap=100)


def test_texts_without_white_space_are_spliced_within_pre_tokens(library, encode):
    r = random.Random(4)
    for letters in ("日本語文章漢字仮名交じり", "abcdefghijklmnopqrstuvwxyz", "été naïve".replace(" ", ""), "ACGT"):
        text = "".join(r.choice(letters) for _ in range(20_000))
        tokens, seams, inner, _ = resynchronised(text, encode, 2048, 512)
        assert tokens == plain(library, text) and inner == seams > 5, letters


def test_random_texts_of_all_kinds(library, encode):
    r = random.Random(9)
    parts = ["the ", "It's ", "we'll", "'", "!!!", "  \n", "\t", "日本", "é", "é", "̣́", "각", "각", "<|endoftext|>", "<|endof", "text|>", "9", "2024", "🙂", "👩‍👩‍👧", "\xa0", "İ", "ß", "ﬁ", "_", "क्षि", "x" * 30, "Ωσ"]
    seams = 0
    for k in range(150):
        text = "".join(r.choice(parts) for _ in range(r.choice((60, 400, 1500))))
        tokens, n, *_ = resynchronised(text, encode, 300, 160, 40)
        seams += n
        assert tokens == plain(library, text), k
    assert seams > 1000


def test_seams_widen_where_encodings_dont_meet(library, encode):
    # Runs of one letter are cut by their length, and between combining marks nothing is stable.
    texts = ["y" * 9_001 + " z", "ab" * 5_000 + " tail " + "word " * 500, "word " * 100 + "=" * 5_003, "\u0301" * 3_000 + "a" * 3_000]
    widened = 0
    for text in texts:
        tokens, _, _, n = resynchronised(text, encode, 512, 192)
        assert tokens == plain(library, text)
        widened += n
    assert widened > 5


PARTS = ["the ", "It's ", " we'll", "'", "!!!", "  \n", "\t", "日本", "é", " ̣́", " ͅ", " ̸", "각", " ᅡ", "ᄀ ", "<|endoftext|>", "<|endof", "text|>", " 2024", "🙂", "\xa0", " İ", "ΟΔΟΣ ", " Σ", "ß", " क्षि", " ", "﻿"]


def test_words_one_after_the_other_are_the_whole_text(library, encode):
    whole = Encoder(FILE)
    whole.apart = False
    assert encode.apart
    r = random.Random(6)
    for k in range(400):
        text = "".join(r.choice(PARTS) for _ in range(r.choice((3, 20, 150))))
        assert encode.counts([text, text]) == [plain(library, text)] * 2, k
        own, other = encode.chunk(text, 2, len(text)), whole.chunk(text, 2, len(text))
        assert all((getattr(own, c) == getattr(other, c)).all() for c in ("start", "ids", "opens", "clean")), k


def test_a_word_goes_to_the_library_once(library):
    encode, seen = Encoder(FILE), []

    class Library:
        def __getattr__(self, name):
            call = getattr(library, name)
            return lambda texts, **options: (seen.extend([texts] if isinstance(texts, str) else texts), call(texts, **options))[1]

    encode.tokenizer = Library()
    short = [" ".join(f"word{(k * j) % 97}" for j in range(300)) for k in range(50)]
    long = " ".join(f"word{(j * j) % 89}" for j in range(20_000))
    assert encode.counts(short) == [plain(library, t) for t in short]
    assert resynchronised(long, encode)[0] == plain(library, long)
    assert sum(map(len, seen)) < 3_000 and sum(map(len, short)) + len(long) > 200_000


def test_known_words_are_bounded_and_other_tokenizers_are_whole(library):
    known = token_counts.Known(lambda words: list(map(len, words)), most=4_000)
    for k in range(200):
        words = [f"{'w' * (k % 7)}{k}", "", "again", f"{k % 5}"]
        assert known.of(words) == list(map(len, words)) and known.held < 5_000 and len(known.words) < 50
    spec = json.loads(library.to_str())
    assert token_counts.stands_apart(spec)
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"added_tokens": [spec["added_tokens"][0] | {"content": "a b"}]}):
        assert not token_counts.stands_apart(spec | change), change
