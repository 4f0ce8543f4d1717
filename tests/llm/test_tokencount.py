from __future__ import annotations

import json
import random
import sys
import unicodedata
from functools import lru_cache

import pytest

from fieldloom.llm import queries, tokencount
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path(queries.TOKENIZER)


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library_counts(path, texts):
    return [len(e.ids) for e in library(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("head", [400_000, 50])
def test_against_the_library(docs, odd_docs, path, head):
    for df in (docs, odd_docs):
        texts = [(repr(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = sorted((i, len(t.encode()), n, n > 1024) for (i, t), n in zip(texts, library_counts(path, [t for _, t in texts]), strict=True))
        found = tokencount.token_counts(df, path, head=head).collect()
        assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want


def test_random_unicode(path):
    rng = random.Random(1)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(chars + [" ", "a", "1", "\n", "'"] * 20_000, k=60)) for _ in range(400)]
    split, one = tokencount.PreTokens(path), {}

    def count(text):
        tokens, total = split(text)
        for t in tokens:
            if t not in one:
                one[t] = library_counts(path, [t])[0]
            total += one[t]
        return total

    assert [count(t) for t in texts] == library_counts(path, texts)
    assert unicodedata.category("՘") == "Cn"


def test_empty_table(no_docs, path):
    assert tokencount.token_counts(no_docs, path).count() == 0
    assert len(TEXTS) > 0


def test_other_tokenizers_are_refused(tmp_path):
    parts = json.loads(open(queries.tokenizer_path(queries.TOKENIZER), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"model": parts["model"] | {"dropout": 0.1}}):
        (tmp_path / "other.json").write_text(json.dumps(parts | change))
        tokencount._library.cache_clear()
        with pytest.raises(ValueError, match="no byte-level BPE"):
            tokencount.PreTokens(str(tmp_path / "other.json"))
