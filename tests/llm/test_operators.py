"""Every operator against its plain version, and the corner cases that its docstring defines."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import op1_wavelet, op2_minhash, op3_fm, op4_suffix, op5_quality, op6_lines, op9_search, op10_pack, registry
from corpusloom.llm.op1_wavelet import WaveletShard, pack_shard, token_counts, token_places, write_shards
from corpusloom.llm.op2_minhash import band_keys, near_duplicates, sketch
from corpusloom.llm.op4_suffix import remove_repeats, suffix_order
from corpusloom.llm.op6_lines import LineShard, PerfectHash, dedup_lines, line_index
from corpusloom.llm.op8_warc import iter_records
from corpusloom.llm.op9_search import integer_vectors, top_k
from corpusloom.llm.op10_pack import pack

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, label string, _doc long, bands string, s string"


def corpus(n=120, seed=5):
    """Texts with near copies, exact copies, shared passages and lines, empties and nulls."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "Straße", "delta", "x1", "of", "the", "omega,", "it's", "日本語", "rho.", "sigma"] + [f"w{i}" for i in range(150)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(60), "A line that many documents hold here"
    docs = []
    for i in range(n):
        kind = i % 10
        if kind == 0 or not docs:
            text = "\n".join(say(rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        elif kind in (1, 2):
            own = (docs[-kind][1] or "").split(" ")
            own[rng.randrange(len(own))] = f"changed{i}"
            text = " ".join(own)
        elif kind == 3:
            text = f"{say(20)}\n{passage}\n{say(10)}"
        elif kind == 4:
            text = f"{say(8)}\n  {line.upper() if i % 20 > 10 else line}\t\n{say(8)}\n\n{line}"
        elif kind == 5:
            text = docs[rng.randrange(len(docs))][1]
        elif kind == 6:
            text = [None, "", " \n\t", "one", "short words only\n"][i // 10 % 5]
        elif kind == 7:
            text = (say(9) + " ") * rng.randint(2, 6)
        elif kind == 8:
            text = "# * | <b> $9 &\n" * 3 + say(25)
        else:
            text = say(300)
        docs.append((3 * i + 1, text))
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def labels(docs):
    return [(d, int(len(t or "") % 3 > 0), 0) for d, t in docs if d % 2]


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def frame(spark, docs):
    rows = [(d, t, "en", "src", len(t or ""), 7, 8, "x", 9, "b", "s") for d, t in docs]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1(spark, docs, folder):
    lib, at = brute.tokenizer(), 0
    found = rows_of(registry.op1_wavelet_tokens(spark, folder))
    for d, text in sorted(docs):
        ids = [*brute.ids_of(lib, text), 1]
        assert found[d]["start"] == at and found[d]["n_tokens"] == len(ids) and found[d]["ids_crc32"] == zlib.crc32(brute.packed(ids))
        at += len(ids)
    assert len(found) == len(docs)


def test_wavelet_lookups():
    ids = np.random.default_rng(1).integers(0, 40, 3000).astype(np.uint16)
    shard = WaveletShard(pack_shard(ids, np.array([1000, 2000]), [None, 4]))
    assert shard.doc_ids == [None, 4] and shard.lengths.tolist() == [1000, 2000] and (shard.ids() == ids).all()
    for token in (0, 7, 39, 40, 99):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.rank(token, 1500) == (places < 1500).sum()
        assert shard.occurrences(token) == places.tolist()
    assert [shard.access(i) for i in (0, 1, 511, 512, 2999)] == ids[[0, 1, 511, 512, 2999]].tolist()
    with pytest.raises(IndexError):
        shard.select(99, 0)


def test_wavelet_lookups_unpack_few_blocks(monkeypatch):
    monkeypatch.setattr(op1_wavelet, "PLANE_BLOCK", 64)
    ids = np.random.default_rng(2).integers(0, 1000, 50_000).astype(np.uint16)
    shard = WaveletShard(pack_shard(ids, np.array([50_000]), [1]))
    assert shard.access(31_234) == ids[31_234]
    assert len([x for x in shard._open if isinstance(x, tuple) and x[0].startswith("plane")]) <= 2 * shard.width
    for i in (0, 511, 512, 513, 40_000, 49_999):
        assert shard.access(i) == ids[i] and shard.rank(int(ids[i]), i + 1) == (ids[: i + 1] == ids[i]).sum()
    assert shard.occurrences(7) == np.flatnonzero(ids == 7).tolist() and (shard.ids() == ids).all()


def test_wavelet_lookups_over_all_files(spark, docs, tmp_path):
    lib = brute.tokenizer()
    manifest = write_shards(frame(spark, docs), f"file://{tmp_path}/shards", shard_tokens=500)
    stream = np.array([x for _, text in sorted(docs) for x in [*brute.ids_of(lib, text), 1]])
    for token in (1, int(stream[0]), 48_000):
        assert sorted(r["place"] for r in token_places(manifest, token).collect()) == np.flatnonzero(stream == token).tolist()
    counts = token_counts(manifest, [1, int(stream[0])]).groupBy("token").agg(F.sum("n").alias("n")).collect()
    assert {r["token"]: r["n"] for r in counts} == {t: int((stream == t).sum()) for t in (1, int(stream[0]))}


@pytest.mark.parametrize("words", [4, 5])
def test_op2(spark, docs, folder, words):
    df = registry.op2_near_duplicates(spark, folder) if words == 4 else near_duplicates(frame(spark, docs), words=words)
    found, wanted = rows_of(df), brute.groups(docs, words)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in found.items()} == {d: (n, c, d == c) for d, (n, c) in wanted.items()}
    assert len({c for _, c in wanted.values()}) < len(docs)


def test_op2_chain_of_near_copies(spark):
    """Links in a chain: the ends are not similar, yet one component."""
    words, docs = [f"t{i}" for i in range(200)], []
    for i in range(30):
        docs.append((i, " ".join(words)))
        words[6 * i : 6 * i + 6] = [f"u{i}_{k}" for k in range(6)]
    found = rows_of(near_duplicates(frame(spark, docs)))
    assert {d: r["component_id"] for d, r in found.items()} == {d: c for d, (_, c) in brute.groups(docs).items()} == {d: 0 for d in range(30)}


def test_op2_bands_find_similar_pairs():
    """Pairs of similarity 0.80 to 0.88, of few and of many shingles, all share a band."""
    rng = np.random.default_rng(4)
    missed = 0
    with np.errstate(over="ignore"):
        for n in (30, 300):
            for _ in range(1500):
                share = rng.uniform(0.80, 0.88)
                both = int(np.ceil(share * 2 * n / (1 + share)))
                items = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
                x, y = band_keys(sketch(items[:n])), band_keys(sketch(np.concatenate((items[:both], items[n:]))))
                missed += not (x == y).any()
    assert missed == 0


def test_op2_blocks(spark, docs, monkeypatch):
    """Blocks of any size give the same groups; a group of many near copies is split over tasks."""
    words = [f"t{i}" for i in range(120)]
    rng, many = random.Random(6), []
    for i in range(60):
        own = list(words)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            own[k] = f"x{i}_{k}"
        many.append((1000 + i, " ".join(own)))
    both = [*docs, *many]
    wanted = {d: c for d, (_, c) in brute.groups(both).items()}
    for size in (1024, 3):
        monkeypatch.setattr(op2_minhash, "BLOCK_MEMBERS", size)
        assert {d: r["component_id"] for d, r in rows_of(near_duplicates(frame(spark, both))).items()} == wanted


def test_op2_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    assert op2_minhash.overlaps(sets[:5], sets[5:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_op3(spark):
    """Held-out accuracy on the small tables; labels of held-out rows change nothing."""
    path = "/root/testdata/sf0.01"
    found = rows_of(registry.op3_quality_classifier(spark, path))
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{path}/documents.parquet").count()
    held = [d for d in truth if found[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert np.mean([found[d]["predicted"] == truth[d] for d in held]) >= 0.85


def test_op3_scores_are_the_sum_over_all_pairs():
    """The linear-time identity against the explicit sum over pairs of features."""
    rng = np.random.default_rng(3)
    machine = op3_fm.Machine()
    machine.bias, machine.w, machine.v = 0.3, rng.normal(0, 1, machine.w.shape), rng.normal(0, 1, machine.v.shape)
    for text in (None, "", "one two two # three", "Word " * 40 + "\n| x |"):
        index, value = op3_fm.features(text)
        pairs = sum(float(machine.v[i] @ machine.v[j]) * float(x) * float(y) for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[a + 1 :])
        assert machine.margin(index, value) == pytest.approx(0.3 + float(machine.w[index] @ value) + pairs, rel=1e-5)


def test_op3_ranks_held_out_documents(spark):
    """Area under the curve on held-out rows; the pairs tell more than the linear part alone; repeated rows train once."""
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    found = rows_of(registry.op3_quality_classifier(spark, path))
    truth = [(found[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["quality"] is not None and found[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in truth if q == x] for x in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.97
    assert np.mean([(s >= 0.5) == bool(q) for s, q in truth]) >= 0.95
    # Which two of three marks stand together decides: no linear score can tell.
    rng, docs = random.Random(2), []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append((i, " ".join([f"w{rng.randrange(30)}" for _ in range(6)] + ["left" if a else "right"] * 3 + ["up" if b else "down"] * 3), int(a == b)))
    rows = spark.createDataFrame([(d, t) for d, t, _ in docs] * 2, "doc_id long, text string")
    own = spark.createDataFrame([(d, q) for d, _, q in docs], "doc_id long, quality int")
    assert op3_fm.training_rows(rows, own).count() == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, _, _ in docs)

    def accuracy(linear):
        machine = op3_fm.Machine()
        if linear:
            machine.v[:], machine.gv[:] = 0, np.inf
        data = [(*op3_fm.features(t), q) for d, t, q in docs if d % 3]
        for k in list(range(len(data))) * 8:
            machine.step(*data[k], 1.0)
        return np.mean([(machine.margin(*op3_fm.features(t)) >= 0) == q for d, t, q in docs if d % 3 == 0])

    assert accuracy(False) > 0.95 > 0.7 > accuracy(True)


def test_op4(spark, docs, folder):
    found = rows_of(registry.op4_suffix_dedup(spark, folder))
    wanted = brute.without_repeats(docs)
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in found.items()} == {d: (n, g, s, brute.sha(k)) for d, (k, n, g, s) in wanted.items()}
    assert sum(x[2] for x in wanted.values()) > 0


@pytest.mark.parametrize("unit", ["a", "ab", "abc" * 40 + "x"])
def test_op4_runs_and_overlaps(spark, unit):
    docs = [(1, unit * (700 // len(unit))), (2, "start " + unit * (300 // len(unit)) + " end"), (3, "y" * 99), (4, "y" * 100), (5, "y" * 101)]
    found = rows_of(remove_repeats(frame(spark, docs), digests=True))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in found.items()} == {d: (n, g, s, brute.sha(k)) for d, (k, n, g, s) in brute.without_repeats(docs).items()}


def test_op4_deals_crowded_anchors_again(spark, monkeypatch):
    """A short line in a new surrounding each time: no group of windows that one task compares grows with the documents."""
    rng = random.Random(9)
    say = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    line, edge = "All rights reserved; see the file LICENSE for terms and conditions of use, copying and distribution.", say(70)
    docs = [(d, say(120) + (edge[-d % 71 :] if d % 3 else "") + line[: 60 + d % 41] + (edge[: d % 67] if d % 4 else "") + say(120)) for d in range(1, 161)]
    groups, plain = [], op4_suffix._Passes.resolved

    def seen(self, entries, crowd):
        marks = plain(self, entries, crowd).persist()
        asked = np.frombuffer(b"".join(r["wanted"] for r in marks.collect()), op4_suffix._ASKED)
        groups.append(int(np.bincount(np.unique(asked["h"], return_inverse=True)[1], asked["n"]).max(initial=0)) if len(asked) else 0)
        return marks

    monkeypatch.setattr(op4_suffix._Passes, "resolved", seen)
    wanted = {d: (n, g, s, brute.sha(k)) for d, (k, n, g, s) in brute.without_repeats(docs).items()}
    for limit in (100_000, 400, 1):
        monkeypatch.setattr(op4_suffix, "BLOCK_WINDOWS", limit)
        groups.clear()
        found = rows_of(remove_repeats(frame(spark, docs), digests=True))
        assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in found.items()} == wanted
        assert max(groups) <= limit and len(groups) <= op4_suffix.RECUTS + 2
        assert (len(groups) > 1) == (limit < 100_000)


def test_op4_spreads_a_hot_anchor(spark, monkeypatch, tmp_path):
    """The segments of one line that stands in all documents are dealt by content: no range holds most of them."""
    monkeypatch.setattr(op4_suffix, "SLICE_BYTES", 10_000)
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    docs = [(d, say(90) + "One line of sixty-five bytes that stands in every document here!!" + say(90)) for d in range(600)]
    manifest = op4_suffix.write_slices(spark.createDataFrame(docs, "c0 long, c1 string"), 0, 1, f"file://{tmp_path}/slices")
    passes = op4_suffix._Passes(manifest, 0, 1, 100)
    rows = passes.first_entries(passes.shared_anchors()).collect()
    held = Counter()
    hot = Counter(h for r in rows for h in np.frombuffer(r["data"], op4_suffix._ENTRY)["h"].tolist()).most_common(1)[0]
    for r in rows:
        held[r["range"]] += int((np.frombuffer(r["data"], op4_suffix._ENTRY)["h"] == hot[0]).sum())
    assert hot[1] >= 300 and max(held.values()) < 4 * hot[1] / passes.ranges


@pytest.mark.parametrize("slice_bytes", [1, 2000, 32_000_000])
def test_op4_rows_that_share_an_id(spark, monkeypatch, slice_bytes):
    """Rows of one id and different texts are places of their own; equal rows are one place; null ids take no part."""
    monkeypatch.setattr(op4_suffix, "SLICE_BYTES", slice_bytes)
    rng = random.Random(3)
    say = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    a, b, c = say(400), say(477), say(300)
    rows = [(1, a), (5, a + "tail"), (5, b), (7, b), (7, b), (8, c), (8, c), (None, a), (9, say(50) + c[40:250]), (9, None), (9, "")]
    found = [(r["doc_id"], r["text"]) for r in remove_repeats(frame(spark, rows)).collect()]
    new = rows[8][1][:50]
    # The last byte of a and the tail stand only once; what follows copied bytes stays.
    want = [(1, a), (5, "tail"), (5, b), (7, ""), (7, ""), (8, c), (8, c), (None, a), (9, new), (9, None), (9, "")]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(found, key=key) == sorted(want, key=key)
    # Two rows of one id that share a passage: one of them keeps it.
    pair = [(3, a + say(40)), (3, say(40) + a)]
    kept = sorted(len(r["text"]) for r in remove_repeats(frame(spark, pair)).collect())
    assert kept == [40, 440]


def test_suffix_order():
    rng = np.random.default_rng(3)
    for size in (1, 2, 50, 2000):
        text = rng.integers(97, 100, size).astype(np.uint8)
        order = suffix_order(text, np.arange(size), depth=size + 1)
        assert order.tolist() == sorted(range(size), key=lambda i: text[i:].tobytes())


def test_op5(spark, docs, labels, folder):
    found = rows_of(registry.op5_quality_rules(spark, folder))
    wanted = brute.quality(docs, [(d, q) for d, q, _ in labels], op5_quality.BUCKETS, op5_quality.SMOOTHING, op5_quality.THRESHOLD)
    for d, text in docs:
        r = found[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_rules(text), d
        assert r["score"] == pytest.approx(wanted[d][0], abs=1e-9)
        assert r["kept"] == wanted[d][1]


def test_op6(spark, docs, folder):
    found = rows_of(registry.op6_line_dedup(spark, folder))
    wanted = brute.without_lines(docs)
    assert {d: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for d, r in found.items()} == {d: (n, g, brute.sha(k.encode())) for d, (k, n, g) in wanted.items()}
    assert sum(x[2] for x in wanted.values()) > 0
    some = line_index(frame(spark, docs), shard_keys=3)  # many shards give the same
    assert {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, docs), some).collect()} == {d: None if t is None else wanted[d][0] for d, t in docs}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    mph = PerfectHash.build(keys)
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys)))


def test_line_shard_with_keys_that_meet():
    """Keys that share the perfect hash's 64 bits are all found; equal keys end the build with an error."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
    with np.errstate(over="ignore"):
        other = h[:7, 1] + np.uint64(99)
        twin = LineShard._key(h[:7, 0], h[:7, 1]) ^ (other * op6_lines._MIX)
    h1, h2 = np.concatenate((h[:, 0], twin)), np.concatenate((h[:, 1], other))
    shard = LineShard.from_bytes(LineShard.build(h1, h2, np.arange(2, 1009), np.arange(1007) - 500).to_bytes())
    found, counts, first = shard.probe(h1, h2)
    assert found.all() and counts.tolist() == list(range(2, 1009)) and first.tolist() == [i - 500 for i in range(1007)] and len(shard.spare) == 7
    assert not shard.probe(h1 + np.uint64(1), h2)[0].any()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def test_op7(spark, docs, folder):
    lib = brute.tokenizer()
    found = rows_of(registry.op7_bpe_roundtrip(spark, folder))
    for d, text in docs:
        ids = brute.ids_of(lib, text)
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (found[d]["n_tokens"], found[d]["ids_sha256"], found[d]["decoded_sha256"]) == (len(ids), brute.sha(brute.packed(ids)), brute.sha(decoded.encode())), (d, text)


def test_op8(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>é</p>", "<p>a</p>", "x" * 200_000, "<p>a</p>", None]
    pages = [(i * 2, f"http://h/{i}" if i != 3 else None, t) for i, t in enumerate(html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "target": F.lit("t")}).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r for r in registry.op8_warc_revisits(spark, str(tmp_path)).collect()}
    last = {}
    for page, _, t in pages:
        last[t or ""] = max(page, last.get(t or "", -1))
    assert len(found) == len(pages)
    for page, _, t in pages:
        data, r = (t or "").encode(), found[page]
        refers = None if last[t or ""] == page else last[t or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers)


def test_warc_reading_is_linear():
    """Ten times the records take about ten times as long."""
    from corpusloom.llm.op8_warc import _record

    text = random.Random(1).randbytes(900).hex().encode()
    times = []
    for n in (400, 4000):
        data = b"".join(_record(i, "u", text, None, None) for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in iter_records(data)) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 25 * times[0]
    with pytest.raises(ValueError):
        list(iter_records(data[:-5]))


def test_warc_records_are_whole():
    from corpusloom.llm.op8_warc import _record

    raw = _record(1, "http://h/1", b"body\r\n\r\nmore", None, None) + _record(2, "http://h/2", b"body\r\n\r\nmore", 1, "http://h/1")
    (head, block), (again, empty) = list(iter_records(raw))
    assert block.endswith(b"\r\n\r\nbody\r\n\r\nmore") and head["WARC-Type"] == "response"
    assert again["WARC-Refers-To"] == head["WARC-Record-ID"] and empty.endswith(b"\r\n\r\n")


def _best(v, ids, n_queries, k=5):
    """Rows (query, rank, vec_id, score) by plain products; ids may repeat."""
    want = []
    for q in sorted({i for i in ids if i % n_queries == 0}):
        asked = ids.index(q)
        best = sorted((-int(v[asked] @ v[c]), ids[c]) for c in range(len(ids)) if ids[c] != q)[:k]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return want


@pytest.mark.parametrize("n, shard", [(400, 60), (400, 7), (3, 60), (1, 60), (0, 60)])
def test_op9(spark, n, shard):
    rng = np.random.default_rng(n)
    data = np.round(rng.normal(0, 0.2, (n, 8)), 2).astype(np.float32)
    if n > 20:
        data[5] = data[7] = data[50]
        data[100:180] = data[100]
    ids = list(range(n))
    if n > 20:  # repeated rows of one id, of a query too
        ids += [100, 100, 3, 3, 3, 3, 3, 3, 3]
        data = np.concatenate((data, data[[100, 100]], data[[3] * 7]))
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, data)]
    odd = [(1000, None), (1050, []), (1100, [float("nan")] + [0.0] * 7), (1150, [None] + [1.0] * 7), (1200, [float("inf")] * 8)] if n > 3 else []
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("p", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(integer_vectors(df), F.col("vec_id") % 50 == 0, shard_vectors=shard).collect())
    assert got == _best(np.floor(256 * data.astype(np.float64)).astype(np.int64), ids, 50)


def test_op9_prunes_shards(spark, monkeypatch):
    """Clustered vectors: most shards are never asked, and no answer is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (20, 16))
    data = (centres[np.arange(2000) % 20] + rng.normal(0, 0.03, (2000, 16))).astype(np.float32)
    pairs, plain = [], op9_search.open_shards

    def seen(queries, manifest, dimension):
        out = plain(queries, manifest, dimension).persist()
        pairs.append((out.count(), queries.count() * (manifest.count() - 1)))
        return out

    monkeypatch.setattr(op9_search, "open_shards", seen)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(integer_vectors(df), F.col("vec_id") % 50 == 0, shard_vectors=50).collect())
    assert got == _best(np.floor(256 * data.astype(np.float64)).astype(np.int64), list(range(2000)), 50)
    assert pairs[0][0] < 0.5 * pairs[0][1]


def test_op9_overflow_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(OverflowError):
        top_k(integer_vectors(df), F.col("vec_id") % 50 == 0)


def test_op10(spark, docs, folder):
    rows = [r.asDict() for r in registry.op10_best_fit_packing(spark, folder).collect()]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[x] for x in names) for r in rows) == brute.pieces(brute.tokenizer(), docs)
    brute.check_packing(rows)


def _bins(sizes, number):
    return {tuple(sorted(sizes[i] for i in x)) for x in number if x}


@pytest.mark.parametrize("kind, bins", [
    ("move", [[3000, 900], [3500], [400]]),
    ("one for one", [[3000, 600], [3600], [1000]]),
    ("two for one", [[3000, 900], [3900, 100], [500, 560]]),
])
def test_packing_steps(kind, bins):
    """Each kind of step acts where it alone helps, and fills the fuller bin."""
    sizes, number = [x for own in bins for x in own], []
    for own in bins:
        number.append(list(range(len(sum(number, [])), len(sum(number, [])) + len(own))))
    search = op10_pack._Search(number, sizes, 4096)
    before = (search.fill**2).sum()
    assert search.step(2), kind
    assert (search.fill**2).sum() > before and search.fill.max() <= 4096
    assert sorted(i for x in search.bins for i in x) == list(range(len(sizes)))
    moved = {"move": {(900, 3000), (400, 3500)}, "one for one": {(1000, 3000), (3600,), (600,)}, "two for one": {(500, 560, 3000), (100, 3900), (900,)}}[kind]
    assert _bins(sizes, search.bins) == moved, kind


def test_packing_search_beats_best_fit():
    """Bins of three pieces each that best-fit decreasing fills badly."""
    for low, high, n in ((830, 1360, 200), (800, 1400, 1000), (1000, 2000, 1000)):
        rng = random.Random(low)
        sizes = [rng.randint(low, high) for _ in range(n)]
        first, bins = op10_pack._best_fit(sizes, 4096), pack(sizes)
        assert sorted(i for x in bins for i in x) == list(range(n))
        assert all(sum(sizes[i] for i in x) <= 4096 for x in bins)
        assert len(bins) < len(first), (low, high)
        # It ends where no step of a donor that could be emptied helps.
        search = op10_pack._Search(bins, sizes, 4096)
        assert len(search.run()) == len(bins)


def test_packing_takes_pairs_from_bins_of_many_pieces():
    sizes = [4081, 10, *[7] * 60]
    search = op10_pack._Search([[0, 1], list(range(2, 62))], sizes, 4096)
    assert search.step(1) and search.fill.tolist() == [4095, 416] and len(search.bins[1]) == 59


def test_long_text(spark, tmp_path):
    """Texts of half a million characters go through every document operator whole, with the plain versions' values."""
    text = " ".join(f"word{i * i % 9973}" + ("\n" if i % 50 == 0 else "") for i in range(60_000))
    docs = [(1, text), (2, text[:-5]), (3, "w" * 200_000), (4, "x" + text[300_000:300_400])]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: rows_of(registry.QUERIES[name](spark, str(tmp_path)))
    lib = brute.tokenizer()
    ids = {d: brute.ids_of(lib, t) for d, t in docs}
    assert {d: (r["n_tokens"], r["ids_crc32"]) for d, r in run("op1_wavelet_tokens").items()} == {d: (len(x) + 1, zlib.crc32(brute.packed([*x, 1]))) for d, x in ids.items()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in run("op2_near_duplicates").items()} == brute.groups(docs)
    assert all(0 <= r["score"] <= 1 for r in run("op3_quality_classifier").values())
    assert {d: (r["n_removed"], r["kept_sha256"]) for d, r in run("op4_suffix_dedup").items()} == {d: (g, brute.sha(k)) for d, (k, _, g, _) in brute.without_repeats(docs).items()}
    assert {d: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for d, r in run("op5_quality_rules").items()} == {d: brute.base_rules(t) for d, t in docs}
    assert {d: (r["n_dropped"], r["kept_sha256"]) for d, r in run("op6_line_dedup").items()} == {d: (g, brute.sha(k.encode())) for d, (k, _, g) in brute.without_lines(docs).items()}
    assert {d: (r["n_tokens"], r["decoded_sha256"]) for d, r in run("op7_bpe_roundtrip").items()} == {d: (len(x), brute.sha(lib.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()}
    rows = [r.asDict() for r in registry.op10_best_fit_packing(spark, str(tmp_path)).collect()]
    brute.check_packing(rows)
    assert sorted(tuple(r[x] for x in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == brute.pieces(lib, docs)


NAMES = [n for n in registry.QUERIES if not n.startswith(("op8_", "op9_"))]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", EXTRA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_corner_rows(spark, tmp_path):
    """Null ids, repeated rows, null and empty texts, several texts of one id; columns of clashing names."""
    long, twice, other = "a text without an id " * 9, "twice the same row " * 9, "\n".join(["a line of its own, and more words"] * 2)
    odd = [(None, long), (None, None), (5, twice), (5, twice), (5, other), (5, None), (6, "")]
    frame(spark, odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lib = brute.tokenizer()
    key = lambda x: tuple((v is None, v) for v in x)
    table = lambda name, *columns: sorted((tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()), key=key)
    rows = lambda f: sorted(((d, *f(d, t)) for d, t in odd), key=key)
    ids = {t: brute.ids_of(lib, t) for _, t in odd}
    assert table("op1_wavelet_tokens", "doc_id", "n_tokens", "ids_crc32") == rows(lambda d, t: (len(ids[t]) + 1, zlib.crc32(brute.packed([*ids[t], 1]))))
    starts = table("op1_wavelet_tokens", "start", "n_tokens")
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert table("op2_near_duplicates", "doc_id", "n_shingles", "component_id", "kept") == rows(lambda d, t: (len(brute.shingles(t, 4)), d, True))
    assert [x[:1] for x in table("op3_quality_classifier", "doc_id", "score")] == [x[:1] for x in rows(lambda d, t: ())]
    alone = lambda d, t: brute.without_repeats([(0, t)])[0] if d is not None else ((t or "").encode(), len((t or "").encode()), 0, 0)
    assert table("op4_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == rows(lambda d, t: (*alone(d, t)[1:], brute.sha(alone(d, t)[0])))
    assert table("op5_quality_rules", "doc_id", "n_words", "n_dup_lines", "base_failed", "score") == rows(lambda d, t: (brute.base_rules(t)[0], brute.base_rules(t)[3], brute.base_rules(t)[5], 0.0))
    assert table("op6_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == rows(lambda d, t: ((t or "").count("\n") + 1, 0, brute.sha((t or "").encode())))
    assert table("op7_bpe_roundtrip", "doc_id", "n_tokens", "decoded_sha256") == rows(lambda d, t: (len(ids[t]), brute.sha(lib.decode(ids[t], skip_special_tokens=False).encode())))
    assert table("op10_best_fit_packing", "doc_id", "length", "ids_crc32") == rows(lambda d, t: (len(ids[t]) + 1, zlib.crc32(brute.packed([*ids[t], 1]))))
    for out in (remove_repeats(frame(spark, odd)), dedup_lines(frame(spark, odd), line_index(frame(spark, odd)))):
        assert out.columns == frame(spark, odd).columns
        assert sorted((d for d, in out.select("doc_id").collect()), key=lambda x: (x is None, x)) == [5, 5, 5, 5, 6, None, None]


def test_corner_pages_and_vectors(spark, tmp_path):
    pages = [(None, None, None), (1, None, "x"), (1, "v", "x"), (2, "u", "x"), (2, "w", "x"), (2, "w", "y"), (3, "w", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "refers_to": F.lit(1)}).write.parquet(f"{tmp_path}/pages.parquet")
    key = lambda x: tuple((v is None, v) for v in x)
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in registry.op8_warc_revisits(spark, str(tmp_path)).collect()), key=key)
    want = [(1, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None), (2, 1, "response", None), (3, 0, "response", None), (None, 0, "response", None)]
    assert found == sorted(want, key=key)
    vectors = [(None, [1.0]), (50, [1.0]), (50, [1.0]), (51, [2.0]), (52, None), (53, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r[x] for x in ("query_id", "rank", "vec_id", "score")) for r in registry.op9_top_k_search(spark, str(tmp_path)).collect()] == [(50, 1, 51, 512 * 256)]
