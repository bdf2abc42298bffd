"""Values of corner cases that other tests see only in part."""

from __future__ import annotations

import base64
import hashlib
import random

import brute

from corpusloom.llm import registry


def test_op3_scores_of_null_empty_repeated_and_long_texts(spark, tmp_path):
    """With a trained model: null is empty, rows of one text have one score, a text of a million characters is read to its end."""
    rng = random.Random(5)
    good, bad = [f"fine{i}" for i in range(40)], [f"junk{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40))) for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(300)]
    long = " ".join(rng.choice(good) for _ in range(150_000))
    odd = [(1000, None), (1001, ""), (None, None), (None, docs[1][1]), (1002, docs[1][1]), (1003, docs[1][1]), (1003, docs[1][1]), (1004, long), (1005, long), (1006, long[: len(long) // 2] + " junk1" * 75_000)]
    spark.createDataFrame(docs + odd, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = registry.op3_quality_classifier(spark, str(tmp_path)).collect()
    score: dict = {}
    for r in rows:
        score.setdefault(r["doc_id"], []).append(r["score"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert len(rows) == len(docs) + len(odd)
    assert score[1000] == score[1001] and score[1000][0] in score[None]
    assert len({*score[1], *score[1002], *score[1003]}) == 1 and len(score[1003]) == 2 and score[1][0] in score[None]
    assert score[1004] == score[1005] and score[1004][0] > 0.5 and score[1006][0] != score[1004][0]
    held = [i for i, _ in docs if i >= 300]
    assert sum((score[i][0] >= 0.5) == bool(i % 2) for i in held) >= 0.9 * len(held)


def test_op8_pages_of_many_megabytes(spark, tmp_path):
    rng = random.Random(1)
    big = "".join(rng.choice("abcdé <>") for _ in range(3_000_000))
    pages = [(1, "http://h/1", big), (2, "http://h/2", big + "x"), (3, "http://h/3", big), (4, "http://h/4", "small")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in registry.op8_warc_revisits(spark, str(tmp_path)).collect()}
    own = lambda t: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode())
    assert found == {1: (*own(big), "revisit", 3), 2: (*own(big + "x"), "response", None), 3: (*own(big), "response", None), 4: (*own("small"), "response", None)}


def test_op2_hub_of_a_large_family(spark, monkeypatch):
    """Near copies of one text, and copies of these: every link is found with the hub's set dealt over salts and buckets by share."""
    from corpusloom.llm import common, op2_minhash

    monkeypatch.setattr(op2_minhash, "HUB_PAIRS", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"x{d % 90}"
        docs.append((d, " ".join(words)))
    docs += [(200 + d, " ".join(rng.choice(base) for _ in range(30))) for d in range(40)] + [(300 + d, docs[7][1]) for d in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_minhash.near_duplicates(frame).collect()}
    assert found == brute.groups(docs)
