"""The pipeline against a composition of the plain versions, stage by stage."""

from __future__ import annotations

import brute
from test_operators import corpus, frame

import corpus_pipeline
from corpusloom.llm import op5_quality


def plain(docs, labels):
    verdict = brute.quality(docs, labels, op5_quality.BUCKETS, op5_quality.SMOOTHING, op5_quality.THRESHOLD)
    docs = [(d, t) for d, t in docs if verdict[d][1]]
    yield docs
    kept = brute.without_lines(docs)
    docs = [(d, kept[d][0]) for d, _ in docs]
    yield docs
    groups = brute.groups(docs, 5)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    yield docs
    cut = brute.without_repeats(docs)
    yield [(d, cut[d][0].decode("utf-8", "ignore")) for d, _ in docs]


def test_pipeline(spark, tmp_path):
    docs = corpus(200, seed=9)
    labels = [(d, int(len(t or "") % 3 > 0)) for d, t in docs if d % 2]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = corpus_pipeline.STAGES
    for i, ((name, stage), want) in enumerate(zip(stages[:-1], plain(docs, labels))):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == sorted(want), name
    rows = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[x] for x in names) for r in rows) == brute.pieces(brute.tokenizer(), want)
    brute.check_packing(rows)
    assert 0 < len(want) < len(docs)


def test_pipeline_without_rows(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_corner_rows(spark, tmp_path):
    """Null ids, repeated rows, several texts of one id, a long text, and column names with dots and of the operators' own."""
    good = " ".join(f"word{i * i % 997}" for i in range(400))
    other, long = " ".join(f"item{i * 7 % 1013}" for i in range(300)), " ".join(f"long{i}" for i in range(30_000))
    docs = [(None, good), (None, good), (1, good), (1, good), (2, good + " end"), (2, other), (3, None), (4, ""), (5, "too short"), (6, long), (7, long[:-9])]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS `a.b`", "1 AS `_hash`", "2 AS _gone", "3 AS c0", "length(text) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append(sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        assert all(r["n_chars"] == len(r["text"]) for r in now.collect()), name
    judged = [(1, good), (1, good), (2, other), (2, good + " end"), (6, long), (7, long[:-9]), (None, good), (None, good)]
    assert kept[0] == judged
    # The whole texts are lines: of equal lines the smallest id keeps its own, rows without an id are left alone.
    assert kept[1] == judged
    # (2, ...) holds a near copy of 1, and 7 one of 6.
    assert kept[2] == [x for x in judged if x[0] not in (2, 7)]
    assert [(d, len(t)) for d, t in kept[3]] == [(d, len(t)) for d, t in brute_cut([x for x in judged if x[0] in (1, 6)], judged)]
    rows = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    brute.check_packing(rows)
    assert sum(r["length"] for r in rows) > 0 and {r["doc_id"] for r in rows} == {1, 6, None}


def brute_cut(known, judged):
    """Rows after passage dedup: each distinct row by itself here, as only equal rows share passages; no id, no change."""
    cut = brute.without_repeats(sorted(set(known)))
    return [(d, cut[d][0].decode("utf-8", "ignore")) for d, _ in known] + [x for x in judged if x[0] is None]
