import base64
import itertools
import os
import random

import pytest

from refaudit.llm import packing, tokens

tiktoken = pytest.importorskip("tiktoken")
PATH = os.path.join(tokens.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n \t", "Hello world, it's 2024!", "<|endoftext|> [MASK] <s>", "aaaaaaaa" * 500, "日本語とкириллица 🏳️‍🌈\x00\x07", "x" * 20_000, "Hello world, it's 2024!"]


def test_ids_equal_the_reference(spark, reference):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference.encode_ordinary(t) if t else []), i


def test_round_trip_and_counts(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([32, 65, 97, 233, 1078, 20013, 128512, 10])) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    counts, flat = tokens.CorpusEncoder().batch(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert tokens.decode(flat[at : at + n].tolist()) == t.encode()
        at += n
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_cache_can_be_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_TOKENS", 3)
    e = tokens.CorpusEncoder()
    a = e.batch(["one two three", "two"])[1].tolist()
    assert e.batch(["one two three", "two"])[1].tolist() == a


def test_fullest_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        counts = {s: rng.randrange(1, 3) for s in rng.sample(range(1, 15), 4)}
        room = rng.randrange(0, 30)
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert all(k <= counts[s] for s, k in chosen.items())
        pool = [s for s, c in counts.items() for _ in range(c)]
        best = max((sum(c) for n in range(len(pool) + 1) for c in itertools.combinations(pool, n) if sum(c) <= room), default=0)
        assert sum(s * k for s, k in chosen.items()) == best


def test_pack_places_every_token_once(spark):
    rng = random.Random(5)
    sizes = [0, None, 10, 10, 10, 25, 1000] + [rng.randrange(1, 12) for _ in range(300)]
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(2, 10, "again")], "doc_id bigint, n_tokens bigint, container string")
    boxes = spark.createDataFrame([("a", 10), ("b", 16), ("zero", 0), ("none", None)], "container string, capacity int")
    rows = packing.pack(items, boxes).collect()
    for name, cap in (("a", 10), ("b", 16)):
        own = [r for r in rows if r["container"] == name]
        load: dict = {}
        for r in own:
            if r["bin_id"] is not None:
                load[r["bin_id"]] = load.get(r["bin_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        total = sum(n or 0 for n in sizes) + 10
        assert sum(load.values()) == total and len(load) <= -(-total // cap) + 3
        big = sorted((r["start"], r["n_tokens"]) for r in own if r["doc_id"] == 6)
        assert sum(n for _, n in big) == 1000 and all(s == i * cap for i, (s, _) in enumerate(big))
        cut = {r["doc_id"] for r in own if r["piece"] > 0}
        assert all((sizes[i] or 0) > cap for i in cut)
        assert {r["doc_id"] for r in own if r["bin_id"] is None} == {0, 1}


def test_pack_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    boxes = spark.createDataFrame([("a", 10)], "container string, capacity int")
    assert packing.pack(none, boxes).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), boxes.limit(0)).count() == 0
