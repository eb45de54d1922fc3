"""Encoding of the whole corpus with a public byte-level BPE (problem 7).

Method: prefix-sharing trie traversal. The distinct words of a batch, sorted, are inserted into a trie of bytes, so
that nodes come up depth first. Each node keeps the last token of the encoding of its prefix, which is the one
vocabulary token that ends there and forms an unbreakable pair with the last token of the prefix before it. The
encoding of a word is read off by stepping back from its node; a prefix that many words share is encoded once.
The trie lives as long as a task and is begun anew beyond ``MOST_NODES`` nodes, which bounds memory and changes
no result. Documents are encoded where they are read; only a table with fewer splits than cores is spread first. The vocabulary is read by
the driver and broadcast; its size is that of the file.

Defined cases: null and empty texts have the empty list; strings of special tokens in a text are ordinary text;
any length of text and word is encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintang.session import default_tokenizer_dir, ship, spread

#: Fixed value: the pattern that cuts a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FULL = regex.compile(PATTERN)
#: The same on ASCII text without the separators that the two libraries class differently.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
SEPARATORS = re.compile("[\x1c-\x1f]")
MOST_NODES = 400_000
MOST_PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token ids and merge ranks of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[ch] for ch in s)
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if all(ch in letters for ch in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))

    def encode(self, word: bytes) -> list[bytes]:
        """Plain merging; used for the pairs of tokens that the trie asks about."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class EncodingTrie:
    """Byte trie; node n has ``last[n]``, the last token of its prefix's encoding, and ``before[n]``, where it begins."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last: list[bytes] = [b""]
        self.before: list[int] = [0]
        self.known = {}

    def pair_stays(self, a: bytes, b: bytes) -> bool:
        """Whether the text of tokens a and b, encoded on its own, is a and b again."""
        found = self.stays.get((a, b))
        if found is None:
            if len(self.stays) > MOST_PAIRS:
                self.stays.clear()
            found = self.stays[a, b] = self.v.encode(a + b) == [a, b]
        return found

    def add(self, word: bytes) -> int:
        """Node of the word; new nodes get their last token from their ancestors."""
        ids, longest = self.v.ids, self.v.longest
        path = [0]
        for end in range(1, len(word) + 1):
            key = path[-1] << 8 | word[end - 1]
            node = self.child.get(key)
            if node is None:
                node = self.child[key] = len(self.last)
                for start in range(max(0, end - longest), end):  # the longest candidate first
                    token = word[start:end]
                    if token in ids and (start == 0 or self.pair_stays(self.last[path[start]], token)):
                        if start == 0 and self.v.encode(token) != [token]:
                            continue
                        self.last.append(token)
                        self.before.append(path[start])
                        break
                else:
                    raise ValueError(f"no encoding for {word[:end]!r}")
            path.append(node)
        return path[-1]

    def ids_of(self, word: bytes) -> list[int]:
        node, out = self.add(word), []
        while node:
            out.append(self.v.ids[self.last[node]])
            node = self.before[node]
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Insert the words not yet known in sorted order, that is depth first."""
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.known)
        for data, word in new:
            if len(self.last) > MOST_NODES:
                kept = self.known
                self.clear()
                self.known = {w: kept[w] for w in words if w in kept}
            self.known[word] = self.ids_of(data)


def cut_words(text: str) -> list[str]:
    """Words before the merges; plain ASCII takes the faster of two equal patterns."""
    return PLAIN.findall(text) if text.isascii() and not SEPARATORS.search(text) else FULL.findall(text)


def encode_texts(texts: list[str | None], trie: EncodingTrie) -> tuple[list[int], list[int]]:
    """(ids of all texts end to end, number of ids of each text)."""
    split = [cut_words(t) if t else [] for t in texts]
    trie.learn({w for ws in split for w in ws})
    known, flat, sizes = trie.known, [], []
    for ws in split:
        before = len(flat)
        for w in ws:
            flat += known[w]
        sizes.append(len(flat) - before)
    return flat, sizes


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row, by the vocabulary file ``tokenizer`` (a path that the driver reads)."""
    shared = ship(df.sparkSession, Vocabulary(tokenizer or os.path.join(default_tokenizer_dir(), "byte_bpe_50k.json")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = EncodingTrie(shared())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, sizes = encode_texts(part.column("text").to_pylist(), trie)
                ids = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("row_id"), ids], names=["row_id", "ids"])

    rows = spread(df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text")), 1)
    return rows.mapInArrow(run, "row_id bigint, ids array<int>").withColumnRenamed("row_id", id_col)
