"""Random secrets are found at any length and alphabet, words are not."""

import random
import string

import pytest

ALPHABETS = {"HEX": "0123456789ABCDEF", "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters}


@pytest.mark.parametrize("name,size", [("HEX", 64), ("HEX", 128), ("base64", 400), ("base64", 512), ("base64", 800), ("letters", 24), ("letters", 40)])
def test_random_strings_are_novel(name, size):
    from tallyspark.llm.secret_scan import novel_spans
    rng = random.Random(size)
    for _ in range(20):
        key = "".join(rng.choices(ALPHABETS[name], k=size))
        assert novel_spans(f"the signature follows: {key} and more".encode(), []) == [(23, 3, 23 + size)]


def test_words_are_not_novel():
    from tallyspark.llm.secret_scan import novel_spans
    for word in ("internationalization", "documentation/security-guidelines", "getUserAccountAuthorization", "com.example.service.impl",
                 "-----------------------", "administrator1administrator2", "config/settings/environment/" * 30):
        assert novel_spans(f"the signature follows: {word} and more".encode(), []) == []
