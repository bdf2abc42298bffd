"""What larger tables bring out: numbers beyond 32 bits, joins that would shuffle all terms, large groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import corpus as C


def test_marks_beyond_32_bits(spark, tmp_path):
    """A count times a word's number may leave 32 bits: here 50 000 times the last of 50 000 words."""
    from corpusloom.queries import files

    words = " ".join(f"w{i:05d}" for i in range(50_000))
    docs = spark.createDataFrame([(1, words, "a"), (2, "w49999 " * 50_000, "a")], "doc_id long, text string, source string")
    docs.withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    found = files.QUERIES["resplit_round_trip"](spark, str(tmp_path)).collect()
    want = sum((i + 1) % 1000003 for i in range(50_000)) + 50_000 * 50_000 % 1000003
    assert [(r["part"], r["label"], r["documents"], r["mark"]) for r in found] == [(1, "a", 2, want)]


def test_terms_are_not_shuffled_by_common_words(spark, monkeypatch):
    """Stop words and common words are broadcast; texts are dealt instead of their terms; the kept terms are the same."""
    docs = spark.createDataFrame([(i, f"the a{i % 3} common common b{i} the"[: 99 if i else 0]) for i in range(40)] + [(7, "common c0")], "doc_id long, text string")
    tf = C.term_counts(docs)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert {(r["word"], r["n"]) for r in tf.where("doc_id = 7").collect()} == {("the", 2), ("a1", 1), ("common", 3), ("b7", 1), ("c0", 1)}
    stop = spark.createDataFrame([("the",)], "word string")
    plan = C.without_stop_words(tf, stop)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = {(r["doc_id"], r["word"], r["n"]) for r in tf.collect() if r["word"] in ("the", "common", "a0", "a1", "a2")}
    for common in (1, 4, 1 << 20):
        monkeypatch.setattr(C, "COMMON", common)
        assert {(r["doc_id"], r["word"], r["n"]) for r in C.without_rare_words(tf, tf).collect()} == want


def _plain_tree(vectors, distance):
    """Leaf order and merges (value, leaves of both) from the definition: all pairs each time."""
    import numpy as np

    groups = [(i, [i], v) for i, v in enumerate(vectors)]
    sums, merges = {i: v.copy() for i, v in enumerate(vectors)}, []
    while len(groups) > 1:
        pairs = [(distance(a[2], b[2]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        value, x, y = min(pairs)
        i, j = groups[x][0], groups[y][0]
        sums[i] = sums[i] + sums[j]
        leaves = groups[x][1] + groups[y][1]
        merges.append((value, len(groups[x][1]), len(leaves)))
        groups[x] = (i, leaves, sums[i] / len(leaves))
        del groups[y]
    return groups[0][1], [v for v, _, _ in merges]


def test_trees_without_a_matrix():
    """Equal rows, ties and blocks of a few rows: leaves and cut values are those of the definition."""
    import numpy as np

    from corpusloom.plans import tree

    rng = np.random.default_rng(5)
    for name, d in (("match", lambda a, b: np.abs(np.cumsum(b - a)).sum()), ("bin", lambda a, b: np.divide((b - a) ** 2, 2 * (b + a), out=np.zeros(len(a)), where=b + a != 0).sum())):
        for width in (3, 25):
            for block in (4, 4096):
                tree.BLOCK = block
                vectors = rng.poisson(0.8, (40, width)).astype(float)
                leaves, cuts = tree.grow(vectors, name)
                want, values = _plain_tree(vectors, d)
                assert leaves == want
                assert [v for _, v, _ in sorted(cuts, key=lambda c: c[2])] == values


def test_trees_of_more_than_8000_rows(spark):
    """No group is refused: 8100 rows on a line, which pair off in order."""
    from corpusloom.plans import tree

    rows = spark.range(8100).select(F.lit(0).alias("run_id"), F.lit(1).alias("y"), F.col("id").alias("doc_id"), F.array(F.floor(F.col("id") / 1350).cast("double")).alias("x"))
    found = tree.trees(rows, "match").agg(F.count("*"), F.count_distinct("doc_id"), F.sum((F.col("cut_value") > 0).cast("int"))).first()
    assert tuple(found) == (8100, 8100, 5)


def test_sizes_of_a_grid_share_one_rank_list(spark, tmp_path, monkeypatch):
    """A topic's information is found once for all numbers of features, and each dataset is what ``prepare`` gives alone."""
    from corpusloom.operators import selection
    from corpusloom.plans import preparation

    tf = spark.createDataFrame([(d, f"w{w}", 1 + (d * w) % 3) for d in range(30) for w in range(8) if (d + w) % 3], "doc_id long, word string, n int")
    docs = spark.createDataFrame([(d, "ab"[d % 2 if d % 7 else 0], int(d % 4 == 0)) for d in range(30)], "doc_id long, label string, part int")
    calls, plain = [], selection.mutual_information
    monkeypatch.setattr(selection, "mutual_information", lambda *args: calls.append(1) or plain(*args))
    found = preparation.topic_grid(tf, docs, ["a"], [2, 5], [("scale_l1", 100)], str(tmp_path))
    assert len(calls) == 1 and [(t, n, x.words) for t, n, x in found] == [("a", 2, 2), ("a", 5, 5)]
    own = docs.selectExpr("doc_id", "part", "cast(label <> 'a' as int) as y")
    for _, number, x in found:
        alone = preparation.prepare(tf, own, [("scale_l1", 100)], number)
        assert sorted(map(tuple, x.train.collect())) == sorted(map(tuple, alone.train.collect()))


def _word_counts(rows, stop=(), least=1):
    """{doc_id: {word: n}} of ASCII texts by the definition, and the words that stay."""
    import re
    from collections import Counter

    counts: dict = {}
    for doc, text in rows:
        counts.setdefault(doc, Counter()).update(re.findall(r"\w{2,}", (text or "").lower()))
    total = sum(counts.values(), Counter())
    kept = {w for w, n in total.items() if n >= least and w not in stop}
    return {d: own for d, c in counts.items() if d is not None and (own := {w: n for w, n in c.items() if w in kept})}, kept


def test_packed_words_by_value(spark, monkeypatch):
    """Blocks of few tokens or of all: the same documents and words; null and repeated ids, empty texts, stop words and words found once."""
    from corpusloom.operators import terms

    rows = [(d, " ".join(f"W{d * i % 17} the x common{'' if i % 3 else d}" for i in range(d % 9))) for d in range(60)]
    rows += [(None, "w1 once common"), (7, "w3 w3 more the"), (7, None), (61, ""), (62, None), (63, "the x y"), (64, "rare1 rare1 rare2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, words = _word_counts(rows, ("the",), 2)
    for block in (1 << 22, 40, 1):
        monkeypatch.setattr(terms, "BLOCK", block)
        packed, known = terms.packed_words(docs, ["the"], 2)
        numbers = sorted((r["_id"], r["word_id"], r["_df"]) for r in known.collect())
        assert [i for i, _, _ in numbers] == list(range(len(words))) and {w for _, w, _ in numbers} == words
        assert [n for _, _, n in numbers] == sorted((n for _, _, n in numbers), reverse=True)
        assert packed.count() == len(want)
        found: dict = {}
        for r in terms.term_rows(packed, known).collect():
            assert r["word_id"] not in found.setdefault(r["doc_id"], {})
            found[r["doc_id"]][r["word_id"]] = r["n"]
        assert found == want
        first, rest = terms.below(packed, 3), terms.term_rows(packed, known, 3)
        assert terms.term_rows(first, known).count() + rest.count() == sum(len(x) for x in want.values())
        assert {r["word_id"] for r in rest.select("word_id").distinct().collect()} == {w for i, w, _ in numbers if i >= 3}
    assert terms.packed_words(docs.where("false"))[0].count() == 0


def test_models_of_packed_documents(spark, monkeypatch):
    """Packed documents give the scores of their term rows, with all words numbered or few."""
    from corpusloom.operators import terms
    from corpusloom.plans import mixture as M

    texts = spark.createDataFrame([(d, " ".join(f"w{(d % 2) * 3 + d * i % 11}" for i in range(d % 8))) for d in range(40)], "doc_id long, text string")
    docs = spark.createDataFrame([(0, d, d % 2 if d % 3 else None) for d in range(41)], "run_id int, doc_id long, y int")
    parts = M.several_parts(docs, [1, 1])

    def scored(tf):
        theta = M.maximise(M.hard_start(docs, parts), tf, parts, M.word_count(tf))
        fit = M.expectation_maximisation(docs, tf, parts, theta, M.word_count(tf), epsilon=-1.0, max_loops=2)
        return {(r["doc_id"], r["k"]): (round(r["score"], 8), round(r["w"], 9)) for r in fit.resp.collect() if r["w"] > 0}

    packed, words = terms.packed_words(texts)
    rows = C.term_counts(texts).withColumnRenamed("word", "word_id")
    want = scored(rows)
    assert scored(M.packed_corpus(packed, words)) == want
    assert scored(M.written(M.packed_corpus(packed, words))) == want
    monkeypatch.setattr(M, "NUMBERS", 8)
    few = M.packed_corpus(packed, words)
    assert M.packed_terms(few, 2).rest is not None and scored(few) == want


def test_features_write_no_row_a_term(spark, tmp_path):
    """What the model queries write is far smaller than the term table: here 300 documents of the same 60 words."""
    from pathlib import Path

    from corpusloom.queries import models
    from corpusloom.session import checkpoint_folder

    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(d, text) for d in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.glob("stored-*"))
    tf, words = models.features(spark, str(tmp_path))
    written = [spark.read.parquet(str(x)).count() for x in set(folder.glob("stored-*")) - before]
    assert words == 60 and written and sum(written) < 300 * 60 / 4
    assert tf.count() == 300 * 60


def test_a_tree_search_reads_a_stretch(monkeypatch):
    """Of 3000 counted rows a small part of the pairs is measured, not the square; trees with few waiting clusters are the same."""
    import numpy as np

    from corpusloom.plans import tree

    rng = np.random.default_rng(9)
    vectors = rng.poisson(rng.gamma(0.7, 60, (3000, 1)) * rng.dirichlet(np.full(30, 0.8), 3000)).astype(float)
    vectors[1000:1400] = vectors[:400]
    measured, plain = [], tree._distances
    monkeypatch.setattr(tree, "_distances", lambda name, one, others: measured.append(len(others)) or plain(name, one, others))
    whole = tree.grow(vectors, "match")
    assert len(whole[0]) == 3000 and [v for _, v, _ in whole[1]].count(0.0) >= 400
    assert sum(measured) < 3000 * 3000 / 40
    monkeypatch.setattr(tree, "FRESH", 3)
    monkeypatch.setattr(tree, "CLOSE", 1)
    assert tree.grow(vectors, "match") == whole


def test_vectors_of_first_words(spark, tmp_path):
    """Counts of the most frequent words of all documents, for labelled ones: repeated ids, empty and null texts."""
    from corpusloom.queries import groups

    rows = [(d, " ".join(f"w{(d * i) % 130}" for i in range(d % 50))) for d in range(300)] + [(7, "w1 w1"), (301, ""), (302, None), (None, "w5 w5")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, _ = _word_counts(rows)
    total: dict = {}
    for _, text in rows:
        for w in (text or "").split():
            total[w] = total.get(w, 0) + 1
    first = sorted(total, key=lambda w: (-total[w], w))[: groups.WIDTH]
    docs = spark.createDataFrame([(d, d % 2) for d in (3, 7, 48, 301, 302, 999)], "doc_id long, y int")
    found = {r["doc_id"]: r["x"] for r in groups._counts(spark, str(tmp_path), docs).collect()}
    assert found == {d: [float(counts.get(d, {}).get(w, 0)) for w in first] for d in (3, 7, 48, 301, 302, 999)}
