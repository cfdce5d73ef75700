"""Words by the model alone against the library's whole way."""

import random

import pytest
from tokenizers import Tokenizer

from lumenfold.llm import align, binary
from lumenfold.llm.wordcache import WordEncoder

ALPHABET = "abcxyzABCXYZ0123456789éÉäßñÑœŒŸÿ×÷ſĳ!#$%&'()*+,-./:;<=>?@[]^_`{|}~"
ODD = ["İx", "ΣΑΣ", "é", "²³¼", "ªµº", "日本", "\x1c", "\x85a", "a\xa0b", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext", "'s", "can't", "WE'LL've'D", "ŉ", "\U0001f600", "x" * 5000, "1" * 300]


@pytest.mark.parametrize("path,front,text", [(binary.VOCABULARY, "", False), (align.SIDE_A, " ", True), (align.SIDE_A, "", False)])
def test_against_the_library(path, front, text):
    rng = random.Random(3)
    words = [front + w for w in [*ODD, *("".join(rng.choices(ALPHABET, k=rng.randrange(1, 14))) for _ in range(20_000)), *(f"{w}{rng.choice(['', ',', '***', chr(39) + 's'])}" for w in ("Hello", "Été", "naïve") for _ in range(9))]]
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = text
    own = WordEncoder(open(path, "rb").read(), specials_are_text=text)
    assert own.cut is not None
    expected = [e.ids for e in whole.encode_batch(words, add_special_tokens=False)]
    assert own.encode(words) == expected == own.encode(words)
