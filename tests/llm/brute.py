"""Plain single-machine versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    return lib


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def shingles(text, size):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def groups(docs, size=4):
    """doc_id -> (set size, component)."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(docs, window=100):
    """doc_id -> (kept bytes, n_bytes, n_removed, n_spans); docs in any order."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (kept, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))))
    return out


def line_key(line):
    line = line.strip(SPACE).translate(UPPER)
    return line if len(line) >= 10 else None


def without_lines(docs):
    """doc_id -> (kept text, n_lines, n_dropped)."""
    holders = {}
    for d, text in docs:
        for key in {line_key(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(key, set()).add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := line_key(x)) is None or len(holders[k]) < 2 or min(holders[k]) == d]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    words = [w.encode() for w in WORD.findall(text or "")]
    first = [xxhash.xxh64_intdigest(w, 42) for w in words]
    pairs = [xxhash.xxh64_intdigest(b, h) for h, b in zip(first, words[1:])]
    return [_signed(h) % buckets for h in first + pairs]


def quality(docs, labels, buckets, smoothing, threshold, share=0.1):
    """doc_id -> (score, kept)."""
    good = {d for d, q in labels if q == 1} - {d for d, q in labels if q == 0}
    raw, target = Counter(), Counter()
    for d, text in docs:
        own = grams(text, buckets)
        raw.update(own)
        if d in good:
            target.update(own)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    prior = smoothing * buckets + share * n_target
    out = {}
    for d, text in docs:
        own = grams(text, buckets)
        ratios = [math.log((target[g] * n_raw / raw[g] + prior) / (n_target + prior)) if n_target else 0.0 for g in own]
        score = sum(ratios) / len(ratios) if ratios else 0.0
        out[d] = (score, not base_rules(text)[5] and score >= threshold)
    return out


def pieces(lib, docs, capacity=4096):
    """Set of (doc_id, piece, start, length, crc)."""
    out = []
    for d, text in docs:
        ids = [*ids_of(lib, text), 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((d, piece, at, len(own), zlib.crc32(packed(own))))
    return sorted(out)


def check_packing(rows, capacity=4096, slack=1.02):
    """Gapless from 0 in every sequence, within the capacity, near the least number of sequences."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(bins) <= slack * math.ceil(total / capacity) + 1
    return len(bins)


def sha(data):
    return hashlib.sha256(data).hexdigest()


GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=3):
    """(words, all runs of 1 to 3 words)."""
    words = GRAM_WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, buckets=10_000, min_words=20, drawn=5):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for _, text in rows for x in features(text)[1]) for rows in (docs, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d, text in docs:
        n, own = features(text)
        h = int(sha(f"42:{'' if d is None else d}".encode())[:8], 16)
        weight = sum(gain(bucket(x)) for x in own)
        out.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = {id(x): i + 1 for i, x in enumerate(able[: drawn * len(able) // 100])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


def trie(turns, group=100, shared=6):
    """Sorted rows (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((x for x in turns if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {c: tuple(own.get(c - c % group, [])[: (h := zlib.crc32(str(c).encode()) % shared)] + x[h:]) for c, x in own.items()}
    members = {}
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below(p) if q)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], sum(not children[q] for q in below(p)), saved, sha(ends.encode())))
    return sorted(out)
