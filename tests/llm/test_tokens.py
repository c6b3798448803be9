import base64
import os
import random

import pytest
import tiktoken

from ledgerloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_equals_the_public_encoder(own):
    ranks, want = own
    enc, rng = tokens.Encoder(ranks), random.Random(1)
    parts = ["a", "aa", "é", "ab ", "  ", "\n", "1", "ő", "漢字", "x" * 33, "'s", "!", "\t", "<|endoftext|>", "​", "🙂"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert enc(t) == want(t)


def test_long_pieces_and_memory(own, monkeypatch):
    ranks, want = own
    monkeypatch.setattr(tokens, "MEMORY", 3)
    enc = tokens.Encoder(ranks)
    for t in ("ab" * 20_000, "word other word third fourth word", " " * 5000):
        assert enc(t) == want(t)


def test_frame(spark, own):
    d = spark.createDataFrame([(1, "Egy szöveg.", [9]), (2, None, None), (3, "", None), (4, "  ", None), (1, "Egy szöveg.", None)], "doc_id bigint, text string, ids array<int>")
    got = [(r.doc_id, r.ids) for r in tokens.encode(d).collect()]
    want = {1: own[1]("Egy szöveg."), 2: [], 3: [], 4: own[1]("  ")}
    assert sorted(got) == sorted((i, want[i]) for i in (1, 2, 3, 4, 1))
    assert tokens.encode(d.where("false")).count() == 0
