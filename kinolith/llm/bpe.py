"""Byte-level BPE encoding with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in one bucket per merge rank; a bucket holds positions in a linked
list of symbols. Three levels of 64-bit words mark the filled buckets, and find-first-set on them
gives the next rank. Positions whose pair has changed since are stale and skipped. Each merge
costs constant time, so a pre-token of a million characters is no special case.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Folder of the public vocabulary files; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: Fixed value: the published pattern that splits texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens up to this many characters are remembered, this many of them at most.
CACHE_CHARS, CACHE_ENTRIES = 48, 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def load_vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict:
    """Byte ids and merges of ``<folder>/<name>.json`` as plain integers, small enough to broadcast."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    found = {
        "bytes": array("i", [ids[c] for c in byte_alphabet()]),
        "left": array("i", [ids[a] for a, _ in merges]),
        "right": array("i", [ids[b] for _, b in merges]),
        "merged": array("i", [ids[a + b] for a, b in merges]),
    }
    found["key"] = f"{folder}/{name}/{zlib.crc32(b''.join(x.tobytes() for x in found.values()))}"
    return found


class RankQueue:
    """A set of ranks with constant-time insert and least-element search."""

    def __init__(self) -> None:
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def drop(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)

    def least(self) -> int:
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1


class Encoder:
    """Encoder of one vocabulary; keep one per worker."""

    def __init__(self, vocabulary: dict, pattern: str = PATTERN) -> None:
        self.byte_ids = vocabulary["bytes"].tolist()
        self.left, self.right = vocabulary["left"].tolist(), vocabulary["right"].tolist()
        self.merged = vocabulary["merged"].tolist()
        self.rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self.length = np.ones(max([*self.byte_ids, *self.merged]) + 1, np.int64)
        for a, b, c in zip(self.left, self.right, self.merged):
            self.length[c] = self.length[a] + self.length[b]
        self.split = regex.compile(pattern)
        self.cache: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply all merges to the symbols of one pre-token."""
        n = len(symbols)
        if n < 2:
            return symbols
        token, rank_of = symbols, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, buckets = RankQueue(), {}
        for i in range(n - 1):
            r = rank_of.get(token[i] << 20 | token[i + 1], -1)
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    queue.add(r)
        while (r := queue.least()) >= 0:
            places = buckets.pop(r)
            queue.drop(r)
            a, b, c = self.left[r], self.right[r], self.merged[r]
            places.sort()
            for i in places:
                j = after[i]
                if token[i] != a or j >= n or token[j] != b:
                    continue  # stale
                token[i], token[j] = c, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r2 = rank_of.get(c << 20 | token[k], -1)
                    if r2 >= 0:
                        if r2 in buckets:
                            buckets[r2].append(i)
                        else:
                            buckets[r2] = [i]
                            queue.add(r2)
                h = before[i]
                if h >= 0:
                    r2 = rank_of.get(token[h] << 20 | c, -1)
                    if r2 >= 0:
                        if r2 in buckets:
                            buckets[r2].append(h)
                        else:
                            buckets[r2] = [h]
                            queue.add(r2)
        return [t for t in token if t >= 0]

    def pretoken(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            byte_ids = self.byte_ids
            ids = self.merge([byte_ids[b] for b in piece.encode("utf-8", "replace")])
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids of a text, without special tokens."""
        out, cache = array("i"), self.cache
        for match in self.split.finditer(text):
            piece = match.group()
            out.extend(cache.get(piece) or self.pretoken(piece))
        return out

    def parts(self, text: str, ids: array, capacity: int) -> list[tuple[int, int, int]]:
        """(tokens, first character, end) of the parts of a text of at most ``capacity`` tokens.

        A text that fits is one part. Cuts stand at the last token border in reach that is a
        character border as well; a single character of more tokens than the capacity stays whole.
        """
        if len(ids) <= capacity:
            return [(len(ids), 0, len(text))]
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        starts = np.append((data & 0xC0) != 0x80, True)
        ends = np.cumsum(self.length[np.frombuffer(ids, np.int32)])
        tokens = np.flatnonzero(starts[ends]) + 1
        chars = np.cumsum(starts[:-1])[ends[tokens - 1] - 1]
        out, done, at = [], 0, 0
        while done < len(ids):
            k = int(np.searchsorted(tokens, done + capacity, "right")) - 1
            if k < 0 or tokens[k] <= done:
                k += 1
            out.append((int(tokens[k]) - done, at, int(chars[k])))
            done, at = int(tokens[k]), int(chars[k])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(broadcast) -> Encoder:
    """The worker's encoder of a broadcast vocabulary, known by the vocabulary's own name and content."""
    vocabulary = broadcast.value
    if vocabulary["key"] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary["key"]] = Encoder(vocabulary)
    return _ENCODERS[vocabulary["key"]]


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array<int>) of every document, without special tokens.

    Null and empty texts have the empty list. The strings of special tokens are ordinary text. Each row is encoded on its own, so repeated ids or
    texts keep their rows; texts of any length are encoded whole; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for begin in range(0, batch.num_rows, 1000):
                ids, offsets = array("i"), array("i", [0])
                part = texts.slice(begin, 1000)
                for text in part:
                    if text.is_valid:
                        ids.extend(encoder.encode(text.as_py()))
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, 1000), lists], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_report(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Documents, tokens and characters per source; null texts count as documents without tokens."""
    ids = token_ids(documents.select(F.struct("source", F.length("text").alias("n")).alias("doc_id"), "text"), folder, name)
    return ids.groupBy("doc_id.source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("ids")).alias("n_tokens"),
        F.sum("doc_id.n").alias("n_text_chars"),
        F.count_if(F.size("ids") == 0).alias("n_empty"),
    )
