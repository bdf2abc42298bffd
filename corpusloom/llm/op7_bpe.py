"""Operator 7: byte-pair encoding and decoding of whole texts.

The encoder reads the public vocabulary file and follows its rules: NFC, white
space, lower case; the split pattern; bytes as printable characters; merges.
Each word is a doubly linked list of symbols with a priority queue of merge
ranks; entries of the queue that no longer match their symbols are skipped.
Decoding joins the vocabulary strings with one space, as the library does for a
file without a decoder.  Words repeat, so each task keeps the ids of recent ones.

Defined results: a null text is an empty one (no ids); texts of any length are
encoded whole, word by word, and a task holds one text's ids at a time; null and
repeated ``doc_id`` values are kept row by row; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .tokens import ChunkEncoder, byte_letters, vocabulary_path

#: White space as the vocabulary file's patterns mean it.
_WHITE = "\t-\r \x85\xa0  -     　"
#: Characters whose class and lower case no two Unicode versions dispute; texts
#: with others are normalised and split by the library, and merged here.
_UNDISPUTED = r"\x00-ԯḀ-⁯₠-₿℀-⯿　-ヿ一-鿿가-힣\U0001f300-\U0001f64f"


class Bpe:
    """encode(text) and decode(ids) of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        #: pair of ids -> (rank, id of the merged symbol)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]
        # The vocabulary file's own patterns; longest added token first.
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"].replace(r"\s", _WHITE)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.disputed = regex.compile(f"[^{_UNDISPUTED}]").search
        self.path, self._lib = path, None
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.known = ChunkEncoder(self._word, self._whole, np.dtype("<u4"))

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest merge rank first, leftmost among equals."""
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, a, b = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two symbols has changed since
            ids[i], ids[j] = merged, -1
            after = right[i] = right[j]
            before = left[i]
            if after >= 0:
                left[after] = i
                found = merges.get((merged, ids[after]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], merged, ids[after]))
            if before >= 0:
                found = merges.get((ids[before], merged))
                if found:
                    heapq.heappush(queue, (found[0], before, found[1], ids[before], merged))
        return [x for x in ids if x >= 0]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words_of(text.lower())
        if not self.disputed(text):
            # Lower case letter by letter: no rule for a final sigma.
            return self.words_of(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        words = self._lib.pre_tokenizer.pre_tokenize_str(self._lib.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, x)).decode("utf-8") for x, _ in words]

    def _word(self, word: str) -> bytes:
        return np.array(self.merge(word), "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        """Ids of any text: special tokens first, then the words between them."""
        out: list[bytes] = []
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out += map(self.known.words.__getitem__, self._words(part))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.known.encode([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """One model per Python worker and vocabulary file."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id with ids and decoded text, or with their SHA-256 digests only."""
    vocabulary = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in slices(batches):
            ids = [bpe.encode(x) for x in batch.column(1).to_pylist()]
            texts = [bpe.decode(x) for x in ids]
            out = {"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in texts], pa.string())
            else:
                out["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kept = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {kept}")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digests=True)
