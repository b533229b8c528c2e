"""The automaton against the tokenizers library."""
import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from stacklens.llm import bpe


def _library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def _texts():
    rng = random.Random(3)
    alphabets = ["ab", "aeinrst ", "the and ing 's 'll \n\t", "àéßñ😀中文字日本 ", "0123456789.,;-_=+*/ ", "<|endoftext|> x", " 　\r\n a", "\x00\x01~"]
    out = ["".join(rng.choice(a) for _ in range(rng.randrange(0, 60))) for a in alphabets for _ in range(400)]
    return out + ["", "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "ha" * 999 + "!", "=" * 777]


def test_automaton_equals_library():
    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        automaton = bpe.Automaton(f.read(), public_tokenizers.PATTERN)
    lib = _library()
    for text in _texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids, text
        assert automaton.decode(ids) == lib.decode(ids, skip_special_tokens=False), text


def test_query_equals_library(docs, odd):
    lib = _library()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id or -1, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
        assert sorted((r.doc_id or -1, *r[1:]) for r in bpe.op3_bpe(df).collect()) == sorted(want)
    assert bpe.op3_bpe(odd.limit(0)).count() == 0
