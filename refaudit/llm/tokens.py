"""Encoding of a corpus with a public byte-level BPE vocabulary by merge replay.

Per task, the texts of an Arrow batch are split into words; the words not met before form a
small corpus of their own. An inverted index from token pair to word positions is built over that
corpus, and every merge that occurs is applied in rank order to all its positions at once; only
the two neighbours of a merged position get new index entries. Documents are then put together
from the word encodings by array gathers. There is no shuffle: the step is one narrow map.

Defined results: a null and an empty text give the empty list; blank texts are encoded like any
other; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("REFAUDIT_TOKENIZER_DIR", "/opt/tokenizers")
#: The public pattern that splits text before the merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A task forgets its words when they hold this many tokens; they are then encoded anew.
CACHE_TOKENS = 4_000_000
#: Characters that are encoded at once.
PIECE = 4_000_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Ranks of the merges of a byte-level BPE vocabulary: pair of ids -> (rank, merged id)."""

    def __init__(self, folder: str, name: str = "byte_bpe_50k") -> None:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.single = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.single[byte] = ids[letter]
        self.base = 1 << 20
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(ids[left] * self.base + ids[right], len(self.merged))
            self.merged.append(ids[left + right])

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all words together, merge by merge in rank order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return [[] for _ in words]
        token = self.single[raw].tolist()
        ends = np.cumsum(sizes)
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        first = np.zeros(n, bool)
        first[(ends - sizes)[sizes > 0]] = True
        at = np.arange(n)
        after = np.where(last, -1, at + 1).tolist()
        before = np.where(first, -1, at - 1).tolist()
        index = self._index(np.asarray(token, np.int64), last)
        queue = list(index)
        heapq.heapify(queue)
        pairs, merged, base = self.pairs, self.merged, self.base
        while queue:
            rank = heapq.heappop(queue)
            positions = index.pop(rank)
            new = merged[rank]
            positions.sort()
            for p in positions:
                q = after[p]
                if token[p] < 0 or q < 0 or pairs.get(token[p] * base + token[q]) != rank:
                    continue
                token[p], token[q] = new, -1
                r = after[q]
                after[p] = r
                if r >= 0:
                    before[r] = p
                    k = pairs.get(new * base + token[r])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heapq.heappush(queue, k)
                o = before[p]
                if o >= 0:
                    k = pairs.get(token[o] * base + new)
                    if k is not None:
                        if k in index:
                            index[k].append(o)
                        else:
                            index[k] = [o]
                            heapq.heappush(queue, k)
        final = np.asarray(token, np.int64)
        kept = final >= 0
        counts = np.add.reduceat(np.append(kept, False), (ends - sizes).clip(max=n)) * (sizes > 0)
        flat, stop = final[kept].tolist(), np.cumsum(counts).tolist()
        return [flat[b - c : b] for b, c in zip(stop, counts.tolist())]

    def _index(self, token: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """Positions of each mergeable pair, by rank of the merge."""
        left = np.flatnonzero(~last)
        if not len(left):
            return {}
        key = token[left] * self.base + token[left + 1]
        kinds, where = np.unique(key, return_inverse=True)
        ranks = np.array([self.pairs.get(k, -1) for k in kinds.tolist()])[where]
        keep = ranks >= 0
        left, ranks = left[keep], ranks[keep]
        order = np.argsort(ranks, kind="stable")
        left, ranks = left[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        return {int(ranks[g[0]]): left[g].tolist() for g in np.split(np.arange(len(ranks)), cuts) if len(g)}


@lru_cache(maxsize=4)
def merge_table(folder: str, name: str) -> MergeTable:
    return MergeTable(folder, name)


class CorpusEncoder:
    """Encodes batches of texts; words met before are looked up."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> None:
        import regex

        self.table = merge_table(folder, name)
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.encoded: list[list[int]] = []
        self.held = 0

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each text, all tokens one after the other)."""
        if self.held > CACHE_TOKENS:
            self._forget()
        words = [self.split(t) if t else [] for t in texts]
        number = self.number
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in number))
        if new:
            start = len(self.encoded)
            found = self.table.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            self.encoded += found
            number.update(zip(new, range(start, start + len(new))))
            self.held += sum(map(len, found)) + len(new)
        per_doc = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(per_doc.sum()))
        used, at = np.unique(at, return_inverse=True)
        lists = [self.encoded[i] for i in used.tolist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter((x for xs in lists for x in xs), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        lengths = size[at]
        out = np.repeat(begin[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        edges = np.concatenate([[0], np.cumsum(per_doc)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return total[edges[1:]] - total[edges[:-1]], pool[out]


def pieces(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about ``most`` characters each, so that a batch of long texts
    needs no more memory than one of short texts; a longer single text is a slice of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids): the token ids of each text, one row per input row, without special tokens.

    Null and empty texts give ``[]``. Repeated rows stay repeated; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(folder, name)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts, PIECE):
                counts, flat = encoder.batch(texts[i:j])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, n_tokens): as :func:`encode`, but only the number of ids leaves the task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(folder, name)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in pieces(texts, PIECE):
                counts, _ = encoder.batch(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(ids: list[int], folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> bytes:
    """The bytes that ids stand for; used for round trips in tests."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return b"".join(back[i] for i in ids)
