"""Importance resampling, cost-balanced packing and the conversation trie against plain versions."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import op11_resample, op12_balance, op13_trie, registry
from corpusloom.llm.op11_resample import bag, importance_resample, packed_bag, unpacked_bag
from corpusloom.llm.op12_balance import balance, balanced_sequences, rooms
from corpusloom.llm.tokens import encoder, vocabulary_path

NULLS_FIRST = lambda x: tuple((v is not None, v) for v in x)
EXTRA = {"n_words": 1, "text_key": "k", "block": 3, "length": 9, "ids": "i", "owner": 2, "depth": 8, "skip": 5, "kind": 7, "bag": "x"}


def extra(df):
    """With columns of names that the operators use themselves."""
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def frame(spark, docs, n=3):
    return extra(spark.createDataFrame(docs, "doc_id long, text string")).repartition(n)


def texts(n=160, seed=4):
    rng = random.Random(seed)
    words = ["The", "the", "of", "déjà", "Straße", "ÀB", "日本語", "x1", "it's", "a-b", "İstanbul"] + [f"w{i}" for i in range(60)]
    out = [(7 * i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    copied = out[3][1] + " copied text with more than twenty words " * 4
    return out + [(10_000 + i, copied) for i in range(60)] + [(1, None), (2, ""), (3, " .,;\n"), (None, copied), (None, None), (4, copied), (4, copied), (4, "another text " * 12)]


def test_op11(spark, tmp_path):
    docs, target = texts(), [(0, "the w1 w2 w3 of w4 copied text"), (1, None), (2, "w1 w2 w3"), (2, "w1 w2 w3")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    extra(spark.createDataFrame(target, "item_id long, text string")).write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("doc_id", "n_features", "weight", "score", "rank")
    found = sorted((tuple(r[x] for x in names) for r in registry.op11_importance_resampling(spark, str(tmp_path)).collect()), key=NULLS_FIRST)
    assert found == sorted(brute.resampled(docs, target), key=NULLS_FIRST)
    assert sorted(x[4] for x in found if x[4]) == list(range(1, 1 + sum(x[4] is not None for x in found)))


def test_op11_settings_and_empty_target(spark):
    docs = texts(40)
    nothing = spark.createDataFrame([], "text string")
    rows = importance_resample(frame(spark, docs), nothing, drawn=50, min_words=5, buckets=97).collect()
    want = brute.resampled(docs, [], buckets=97, min_words=5, drawn=50)
    names = ("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r[x] for x in names) for r in rows), key=NULLS_FIRST) == sorted(want, key=NULLS_FIRST)
    with pytest.raises(ValueError):
        importance_resample(frame(spark, docs), nothing, buckets=1 << 17)


def test_bag_is_the_same_in_any_blocks():
    text = " ".join(f"Word{i * i % 977}" for i in range(400))
    n, own = brute.features(text)
    want = sorted(zlib.crc32(x.encode()) % 10_000 for x in own)
    for size in (1, 7, 100, 1 << 20):
        words, found = bag(text, block=size)
        assert words == n and found.tolist() == want, size
    assert unpacked_bag(packed_bag(np.array(want))).tolist() == want and unpacked_bag(packed_bag(np.zeros(0, np.int64))).tolist() == []
    for short in ("", "one", "one two"):
        assert bag(short)[1].tolist() == sorted(zlib.crc32(x.encode()) % 10_000 for x in brute.features(short)[1])


def test_op11_copies_meet_in_no_join(spark):
    """The text that most documents have is one row of features, and is broadcast."""
    docs = [(i, "the same long text " * 10) for i in range(3000)] + [(5000 + i, f"own text number {i}") for i in range(300)]
    assert op11_resample.bags(frame(spark, docs, 8)).count() == 301
    rows = importance_resample(frame(spark, docs, 8), spark.createDataFrame([("text",)], "text string")).collect()
    assert len(rows) == 3300 and sum(r["rank"] is not None for r in rows) == 150
    assert len({r["weight"] for r in rows if r["doc_id"] < 3000}) == 1


def check_sequences(rows, docs, capacity):
    lib, width = library(), {}
    ids = {}
    for d, text in docs:
        ids.setdefault(d, []).append([*lib.encode(text or "", add_special_tokens=False).ids, 1])
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append(r)
        assert r["length"] > 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0, at  # no padding at all
    for d, own in ids.items():
        if len(own) == 1:
            at = 0
            for r in sorted(parts[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(own[0])
                assert r["ids_crc32"] == zlib.crc32(brute.packed(own[0][at : at + r["length"]]))
                at += r["length"]
            assert at == len(own[0])
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    return bins, width


def test_op12(spark, tmp_path):
    docs = texts() + [(90_000, " ".join(f"long{i}" for i in range(9000))), (90_001, "x" * 60_000), (90_002, "two  spaces \n\n and <|endoftext|> inside")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    check_sequences(registry.op12_cost_balanced_packing(spark, str(tmp_path)).collect(), docs, 2048)


def test_op12_blocks_and_ids(spark):
    docs = [x for x in texts() if x[0] is not None and x[0] != 4]
    rows = balanced_sequences(frame(spark, docs), capacity=64, block_documents=40).collect()
    bins, _ = check_sequences(rows, docs, 64)
    assert all(zlib.crc32(np.frombuffer(r["ids"], np.uint16).astype("<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert len({s >> 32 for s in bins}) > 3 and sum(sum(n for _, n in x) < 64 for x in bins.values()) <= 6 * len({s >> 32 for s in bins})
    with pytest.raises(ValueError):
        balanced_sequences(frame(spark, docs), capacity=100)


def test_rooms():
    assert rooms(0) == [] and rooms(4096) == [2048, 2048] and rooms(2048 + 1365) == [2048, 1024, 256, 64, 16, 4, 1]


def test_balance_levels_cost_with_few_cuts():
    rng = random.Random(2)
    sizes = [rng.choice((rng.randint(1, 60), rng.randint(100, 900))) for _ in range(3000)]
    parts = balance(sizes)
    assert sum(p[2] for p in parts) == sum(sizes) and sorted({p[0] for p in parts}) == list(range(3000))
    full = sum(sizes) // 2048
    assert len(parts) - len(sizes) <= full + 11

    def squares(parts):
        cost = {}
        for _, _, length, sequence, _ in parts:
            cost[sequence] = cost.get(sequence, 0) + length * length
        return np.array([cost[s] for s in range(full)])

    # In the order of the documents, sequence by sequence.
    plain, at = [], 0
    for i, n in enumerate(sizes):
        while n:
            k = min(n, 2048 - at % 2048)
            plain.append((i, 0, k, at // 2048, 0))
            at, n = at + k, n - k
    assert squares(parts).std() < 0.5 * squares(plain).std()


def test_spaced_encoder():
    lib, own, rng = library(), encoder(vocabulary_path("byte_bpe_50k.json"), spaced=True), random.Random(3)
    bits = [*" \n\t\r\x0b\x1c\x1f　  \x85'''abcdstmlreéÉßªºµ²½日本字١2٣-.,!<|>ﬁı̇İ​\x00", "<|endoftext|>", "  ", "'s", "'ll", " \n", "don't", "word,", " (word)"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def talks(n=260, seed=6):
    """Conversations of a few turns with common beginnings, whole copies, ties, nulls and gaps."""
    rng, out = random.Random(seed), []
    for c in range(n):
        if c % 17 == 3:
            continue
        length = rng.randint(1, 9)
        for t in range(length):
            text = f"turn {t} {'é' * (t % 3)}" if rng.random() < 0.7 else f"own {c} {t} 日本"
            out.append((c, t, ("user", "assistant")[t % 2], text))
    out += [(5000 + i, t, "user", f"copied {t}") for i in range(80) for t in range(12)]
    out += [(None, 0, "user", "nobody's"), (300, None, None, None), (300, None, "user", "first"), (300, 0, "user", None), (300, 0, "user", None), (301, 4, "", "")]
    return out


def conversations(spark, rows):
    return extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(4)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_op13(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_trie, "ENDS_BYTES", 50)
    rows = talks()
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(tuple(r[x] for x in NODE) for r in registry.op13_conversation_trie(spark, str(tmp_path)).collect())
    assert found == brute.trie(rows)
    assert len({x[:2] for x in found}) == len(found)


def test_op13_without_takeovers(spark):
    """The trie of the conversations as they are; long ones too, whose chains are summed, not every pair of turns."""
    from corpusloom.llm.common import saved

    long = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(600)] + [(4, t, "user", f"t{t}") for t in range(300)] + [(4, 300, "user", "leaves")]
    found = op13_trie.prefix_trie(saved(op13_trie.prefixes(conversations(spark, long)), "test-prefixes"))
    got = sorted(tuple(r[x] for x in NODE) for r in found.collect())
    assert got == brute.trie(long, shared=1)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_importance_resampling", "op12_cost_balanced_packing", "op13_conversation_trie"):
        assert registry.QUERIES[name](spark, str(tmp_path)).collect() == [], name
