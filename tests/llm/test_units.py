"""Units of the tokenizer: cut where matches end, told apart, each merged once."""

import random

import public_tokenizers as P
from lodestack.llm import bpe, queries

MARKS = [*"!,.;:()[]#*$%&|<>-_=+/\\\"'`~{}@^?"]
WHITE = [*"\t\n\x0b\x0c\r\x1c\x1f\x85\xa0᠎  　"]
PARTS = ["a", "word", "Zürich", "ɏ", "×", "÷", "ɐ", "'s", "'ll", "'", "''", "!'t", "7", "٣", "²", "123456", "日本", "🙂", "\x00", "\x7f", "<|endoftext|>", " ", " ", " ", "  ", *MARKS, *WHITE]


def random_texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["", " ", "\n", "  a", "a  ", "a\n", *("".join(rnd.choices(PARTS, k=rnd.randint(0, 30))) for _ in range(n))]


def test_units_equal_tokenizers():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    other, mine = Tokenizer.from_file(path), bpe.ByteBPE(path)
    some = random_texts(11, 8000)
    for t, ids in zip(some, mine.encode_all(some), strict=True):
        assert ids.tolist() == other.encode(t, add_special_tokens=False).ids


def test_units_equal_tiktoken_by_any_pattern():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    some = random_texts(12, 4000)
    joined = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    for pattern in (P.PATTERN, joined):
        other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        for t, ids in zip(some, bpe.ByteBPE(path, pattern).encode_all(some), strict=True):
            assert ids.tolist() == other.encode_ordinary(t)


def test_each_match_is_merged_once(monkeypatch):
    """Lines that begin and words that end in many ways gave a unit for each pair of words and marks."""
    given = []
    fast, plain = bpe.ByteBPE._fast, bpe.ByteBPE._plain
    monkeypatch.setattr(bpe.ByteBPE, "_fast", lambda self, x: fast(self, given.extend(map(str, x)) or x))
    monkeypatch.setattr(bpe.ByteBPE, "_plain", lambda self, x, *a: plain(self, given.extend(map(str, x)) or x, *a))
    mine = bpe.ByteBPE(queries.vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdeé", k=7)) for _ in range(60)]
    ends = [".", ",", ");", "2."]
    text = " ".join(f"{a}{rnd.choice(ends)}\n{b}" for a in words for b in words)
    first, second = mine.encode_all([text, text[:1000]]), mine.encode_all([text, text[:1000]])
    assert [x.tolist() for x in first] == [x.tolist() for x in second]
    assert len(given) <= 2 * len(words) + len(ends) + 10
