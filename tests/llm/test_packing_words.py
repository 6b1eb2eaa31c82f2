"""Ids of words, against the tokenizer itself."""

from __future__ import annotations

from itertools import product

from tokenizers import Tokenizer

from tessera.llm import packing, queries

STEMS = ["Attior", "ÉÉVI", "straße", "ÀÖØÞ", "ÿ", "ª", "ﬁn", "ΣΟΦΟΣ", "İstanbul", "ŁÓDŹ", "Дом", "ไทย", "x1", "it's", "été", "<|endoftext|>", "end of", "a\x0bb", "​"]
TAILS = ["", ".", ",", "%%%", "$$$", "###", "!?", ").", "'", ">", "…", ".a", "\r"]


def test_words_have_the_ids_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    words = [stem + tail for stem, tail in product(STEMS, TAILS)]
    for cached in (30, 10_000):
        known = packing.WordIds(queries.TOKENIZER, cached)
        for _ in range(2):
            texts = [*words, " ".join(words), "\n".join(words[::-1]), "", " \n "]
            assert known.of(texts) == [b"".join(k.to_bytes(4, "little") for k in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_latin_words_skip_the_normaliser(monkeypatch):
    """Words of Latin letters, with signs after them or without, aren't normalised and split once more."""
    known, seen = packing.WordIds(queries.TOKENIZER), []
    encode = known.encode
    monkeypatch.setattr(known, "encode", lambda texts: seen.extend(texts) or encode(texts))
    known.of(["Attior, éévi ÉÉVI%%% enanat$$$ Hash"])
    assert all(x in ("", ",", "%%%", "$$$") for x in seen)
