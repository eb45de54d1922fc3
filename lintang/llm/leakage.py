"""Evaluation texts leaking into training text (problem 8).

Method: latent semantic retrieval. Documents become sequences of term numbers over the words of the evaluation items. Passages of 24
words are TF-IDF rows; a distributed randomised SVD (subspace iteration on the Gram matrix, summed over partitions) gives the latent
space. Vectors of the items are kept in an index of clusters; a vector of a document is compared only with clusters that its
angle to their centre, less their radius, does not exclude, so the index loses nothing and time follows the hits.

* ``leaks``: every item is cut into blocks of half the wanted run, every document into windows of that length at each word. A passage
  that stands in a document word for word contains a whole block, has the same bag of words in that window and so cosine 1
  in any latent space: no verbatim leak is lost. The longest common run decides.
* ``paraphrases``: passages of documents, foreign words included, against passages of items at a lower cosine. The longest common
  subsequence of the item and the stretch around its passages decides, and an answer check: how many of the item's
  numbers (data and results) the stretch holds.

Size bounds: only the evaluation set is broadcast and held by the driver, at most ``MOST_ITEMS`` items at a time; more items are worked off
in such blocks. The latent space is fitted on the documents of a hash class of about ``MOST_FITTED`` and all items; document counts cover
all documents, and every document is searched.

Defined cases: null and blank texts have no words and no leak; items shorter than the run have none; repeated
documents and items are each reported; an empty side gives an empty result; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintang.functions.words import words
from lintang.session import materialize, ship, spread

MOST_ITEMS = 20_000
MOST_FITTED = 5_000
PASSAGE = 24
CLUSTERS = 96
#: Terms of documents that are searched at a time; stretches that go on are overlapped.
PIECE = 40_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_of(word: str) -> int:
    return int(np.array([xxhash.xxh64_intdigest(word.encode(), 42)], np.uint64).view(np.int64)[0])


@dataclass
class Items:
    """Evaluation items as term numbers."""

    ids: list[int]
    terms: list[np.ndarray]
    vocabulary: np.ndarray  # sorted hashes of the words; the term number is the place
    numeric: np.ndarray  # whether a term is a number

    @staticmethod
    def of(rows: list[tuple[int, str | None]], least: int) -> Items:
        split = [(i, ws) for i, text in rows if len(ws := words_of(text)) >= max(least, 1)]
        hashes = {w: hash_of(w) for _, ws in split for w in ws}
        vocabulary, at = np.unique(np.array(list(hashes.values()), np.int64), return_index=True)
        names = np.array(list(hashes), dtype=object)[at] if hashes else np.array([], dtype=object)
        number = {w: int(np.searchsorted(vocabulary, h)) for w, h in hashes.items()}
        return Items([i for i, _ in split], [np.array([number[w] for w in ws], np.int32) for _, ws in split], vocabulary, np.array([n.isdigit() for n in names], bool))


def term_sequences(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms): the term number of each word, -1 outside the vocabulary; runs of -1 are cut to one."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column("hashes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            terms = np.where(known[at] == flat, at, -1).astype(np.int32)
            document = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            keep = terms >= 0
            keep[1:] |= (terms[:-1] >= 0) | (document[1:] != document[:-1])
            inside = np.bincount(document, terms >= 0, batch.num_rows) > 0
            keep &= inside[document]
            sizes = np.bincount(document[keep], minlength=batch.num_rows)[inside]
            out = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(terms[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(inside)), out], names=["doc_id", "terms"])

    hashed = documents.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.mapInArrow(run, "doc_id bigint, terms array<int>")


def passage_matrix(sequences: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the TF-IDF rows of unit length of the passages of some documents."""
    rows, columns, first = [], [], 0
    for terms in sequences:
        place = first + np.arange(len(terms)) // PASSAGE
        first += -(-len(terms) // PASSAGE)
        inside = terms >= 0
        rows.append(place[inside]), columns.append(terms[inside])
    row, column = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*columns, np.zeros(0, np.int32)])
    cells, counts = np.unique(row * len(idf) + column, return_counts=True)
    row, column = cells // len(idf), cells % len(idf)
    weight = counts * idf[column]
    return row, column, weight / np.sqrt(np.bincount(row, weight * weight))[row] if len(row) else weight


def gram_product(sequences: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """X' X Q of the passages of some documents."""
    row, column, weight = passage_matrix(sequences, idf)
    total = np.zeros_like(basis)
    if not len(row):
        return total
    heads = np.flatnonzero(np.append(True, np.diff(row) > 0))
    projected = np.add.reduceat(basis[column] * weight[:, None], heads)
    place = np.cumsum(np.append(False, np.diff(row) > 0))
    order = np.argsort(column, kind="stable")
    back = projected[place[order]] * weight[order][:, None]
    starts = np.flatnonzero(np.append(True, np.diff(column[order]) > 0))
    total[column[order][starts]] = np.add.reduceat(back, starts)
    return total


def _sum_matrices(partial: DataFrame) -> DataFrame:
    """Sums (part, salt, data) by part in two steps, so that no task holds the matrices of all partitions."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, dtype=np.float64) for d in pdf["data"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "salt": [0], "data": [total.tobytes()]})

    schema = "part int, salt int, data binary"
    return partial.groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)


def latent_space(sequences: DataFrame, items: Items, idf: np.ndarray, rank: int = 64, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors of the passages' TF-IDF matrix."""
    size = len(idf)
    rank = min(rank, size)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    context = sequences.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((basis, idf))

        def gram(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, weights = shared.value
            total, seen = np.zeros_like(q), 0
            for batch in batches:
                seen ^= int(pd.util.hash_array(batch["doc_id"].to_numpy()).sum()) if len(batch) else 0
                for at in range(0, len(batch), 500):
                    total += gram_product([np.asarray(t, np.int32) for t in batch["terms"].iloc[at : at + 500]], weights, q)
            for part, rows in enumerate(np.array_split(total, max(1, len(total) // 512))):
                yield pd.DataFrame({"part": [part], "salt": [seen % 64], "data": [rows.tobytes()]})

        parts = _sum_matrices(sequences.mapInPandas(gram, "part int, salt int, data binary")).orderBy("part").collect()
        summed = gram_product(items.terms, idf, basis)
        if parts:
            summed = summed + np.concatenate([np.frombuffer(p["data"], dtype=np.float64) for p in parts]).reshape(size, rank)
        basis = np.linalg.qr(summed + 1e-9 * basis)[0]
        shared.unpersist()
    return basis


class ClusterIndex:
    """Unit vectors in clusters; finds all pairs with at least a cosine, by the angles to the centres."""

    def __init__(self, vectors: np.ndarray, clusters: int = CLUSTERS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        count = min(clusters, len(vectors))
        centres = vectors[rng.permutation(len(vectors))[:count]].copy()
        for _ in range(6):
            own = (vectors @ centres.T).argmax(axis=1)
            for k in range(count):
                if (own == k).any():
                    mean = vectors[own == k].sum(axis=0)
                    centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
        own = (vectors @ centres.T).argmax(axis=1)
        self.centres = centres
        self.members = [np.flatnonzero(own == k) for k in range(count)]
        self.parts = [vectors[m] for m in self.members]
        angle = lambda k: np.arccos(np.clip(self.parts[k] @ centres[k], -1, 1)).max() if len(self.members[k]) else -1.0
        self.radius = np.array([angle(k) for k in range(count)])

    def search(self, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the vector, place of the indexed one, cosine)."""
        reach = np.cos(np.minimum(np.arccos(cosine) + self.radius, np.pi)) - 1e-4
        near = vectors @ self.centres.T >= reach
        out = []
        for k in np.flatnonzero(near.any(axis=0)):
            rows = np.flatnonzero(near[:, k])
            if len(self.members[k]):
                cosines = vectors[rows] @ self.parts[k].T
                i, j = np.nonzero(cosines >= cosine)
                out.append((rows[i], self.members[k][j], cosines[i, j]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def longest_run(a: list[int], b: list[int]) -> int:
    """Length of the longest common run of two sequences."""
    best, previous = 0, {}
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        if x >= 0:
            where.setdefault(x, []).append(j)
    for x in a:
        current = {j: previous.get(j - 1, 0) + 1 for j in where.get(x, ())}
        best = max(best, max(current.values(), default=0))
        previous = current
    return best


def longest_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, rows as bit sets."""
    match: dict[int, int] = {}
    for j, x in enumerate(b):
        match[x] = match.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & match.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - bin(row).count("1")


def pieces(batch: pd.DataFrame, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document numbers, terms) of about PIECE terms: documents end to end, -1 between them; parts of long ones overlap."""
    rows, terms, held = [], [], 0
    for number, sequence in enumerate(batch["terms"]):
        whole = np.asarray(sequence, np.int32)
        for at in range(0, max(len(whole) - overlap, 1), PIECE):
            part = whole[at : at + PIECE + overlap]
            rows.append(np.full(len(part) + 1, number)), terms.append(np.append(part, -1))
            held += len(part) + 1
            if held >= PIECE:
                yield np.concatenate(rows), np.concatenate(terms)
                rows, terms, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(terms)


def window_sums(vectors: np.ndarray, terms: np.ndarray, size: int) -> np.ndarray:
    """Sum of the term vectors of each window of ``size`` terms; foreign words add nothing."""
    padded = np.vstack((vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)))  # -1 takes the last row
    summed = np.vstack((np.zeros((1, vectors.shape[1])), np.cumsum(padded[terms], axis=0, dtype=np.float64)))
    return summed[size:] - summed[:-size]


def _leaks_of(sequences: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, run: int, cosine: float) -> DataFrame:
    half = max(run // 2, 1)
    vectors = (basis * idf[:, None]).astype(np.float32)
    # every run of ``run`` words contains a whole aligned block of half its length
    blocks = [(k, terms[at : at + half]) for k, terms in enumerate(items.terms) for at in range(0, len(terms) - half + 1, half)]
    index = ClusterIndex(unit(np.stack([vectors[terms].sum(axis=0) for _, terms in blocks])))
    shared = ship(sequences.sparkSession, (items, np.array([k for k, _ in blocks]), index, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, owners, index, vectors = shared()
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for document, terms in pieces(batch, 4 * run):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (terms >= 0).view(np.int8), [0]))))
                starts, ends = edges[::2], edges[1::2]
                long = ends - starts >= run
                starts, ends = starts[long], ends[long]
                if not len(starts):
                    continue
                # windows inside the stretches only
                counts = ends - starts - half + 1
                at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                stretch = np.repeat(np.arange(len(starts)), counts)
                windows = unit(window_sums(vectors, terms, half)[at])
                where, block, near = index.search(windows, cosine)
                pairs = pd.DataFrame({"stretch": stretch[where], "item": owners[block], "near": near})
                for (s, k), near in pairs.groupby(["stretch", "item"])["near"].max().items():
                    said, asked = terms[starts[s] : ends[s]].tolist(), items.terms[k].tolist()
                    row = (float(near), longest_run(said, asked), longest_subsequence(said, asked) / len(asked))
                    key = (int(document[starts[s]]), k)
                    best[key] = tuple(map(max, row, best.get(key, row)))
            ids = batch["doc_id"].to_numpy()
            rows = [(items.ids[k], ids[d], *values) for (d, k), values in best.items()]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "cosine", "run", "lcs_share"])

    return sequences.mapInPandas(search, LEAKS)


def _paraphrases_of(sequences: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float, least: float) -> DataFrame:
    vectors = (basis * idf[:, None]).astype(np.float32)
    parts = [(k, terms[at : at + PASSAGE]) for k, terms in enumerate(items.terms) for at in range(0, max(len(terms) - PASSAGE // 2, 1), PASSAGE // 2)]
    index = ClusterIndex(unit(np.stack([vectors[terms].sum(axis=0) for _, terms in parts])))
    shared = ship(sequences.sparkSession, (items, np.array([k for k, _ in parts]), index, vectors))
    longest = 2 * max(map(len, items.terms))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, owners, index, vectors = shared()
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for document, terms in pieces(batch, longest):
                if len(terms) < PASSAGE:
                    document, terms = np.append(document, np.full(PASSAGE, document[-1])), np.append(terms, np.full(PASSAGE, -1))
                at = np.arange(0, len(terms) - PASSAGE + 1, PASSAGE // 4)
                inside = np.append(0, np.cumsum(terms >= 0))
                at = at[inside[at + PASSAGE] - inside[at] >= 8]
                if not len(at):
                    continue
                where, part, near = index.search(unit(window_sums(vectors, terms, PASSAGE)[at]), cosine)
                pairs = pd.DataFrame({"at": at[where], "item": owners[part], "near": near})
                for (d, k), group in pairs.groupby([document[pairs["at"] + PASSAGE // 2], "item"]):
                    asked = items.terms[k]
                    reach = np.zeros(len(terms), bool)
                    for place in group["at"]:
                        reach[max(0, place - len(asked)) : place + PASSAGE + len(asked)] = True
                    own = np.flatnonzero(reach & (document == d))
                    said = terms[own[0] : own[-1] + 1]
                    numbers = np.unique(asked[items.numeric[asked]])
                    answers = float(np.isin(numbers, said).mean()) if len(numbers) else 1.0
                    share = longest_subsequence(said.tolist(), asked.tolist()) / len(asked)
                    if share >= least:
                        row = (float(group["near"].max()), longest_run(said.tolist(), asked.tolist()), share, answers)
                        best[int(d), k] = tuple(map(max, row, best.get((int(d), k), row)))
            ids = batch["doc_id"].to_numpy()
            rows = [(items.ids[k], ids[d], *values) for (d, k), values in best.items()]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "cosine", "run", "lcs_share", "answer_share"])

    return sequences.mapInPandas(search, f"{LEAKS}, answer_share double")


LEAKS = "item_id bigint, doc_id bigint, cosine double, run int, lcs_share double"


def _blocks(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, least: int, rank: int) -> Iterator[tuple]:
    """(sequences, items, idf, basis) per block of MOST_ITEMS items."""
    docs = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")), 1)
    numbered = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    parts = max(1, -(-numbered.count() // MOST_ITEMS))
    for part in range(parts):
        block = numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        own = Items.of([(r["item_id"], r["text"]) for r in block], least)
        if not own.ids:
            continue
        sequences = materialize(term_sequences(docs, own.vocabulary))
        seen = sequences.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect()
        total = sequences.count()
        counts = np.zeros(len(own.vocabulary))
        for r in seen:
            if r["term"] >= 0:
                counts[r["term"]] = r["count"]
        idf = np.log((1 + total) / (1 + counts)) + 1
        share = min(1.0, MOST_FITTED / max(total, 1))
        fitted = sequences.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
        yield sequences, own, idf, latent_space(fitted, own, idf, rank)


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, run: int = 12, cosine: float = 0.95, rank: int = 64
) -> DataFrame:
    """(item_id, doc_id, cosine, run, lcs_share) of every document and item that share a latent window.

    ``run``: words of the longest common run; ``lcs_share``: longest common subsequence within a stretch of the document by
    the item's length. A verbatim leak has ``run`` >= the wanted run.
    """
    result = documents.sparkSession.createDataFrame([], LEAKS)
    for sequences, own, idf, basis in _blocks(documents, items, doc_id, doc_text, item_id, item_text, run, rank):
        result = result.unionByName(_leaks_of(sequences, own, idf, basis, run, cosine))
    return result


def paraphrases(
    documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, cosine: float = 0.7, least: float = 0.6, rank: int = 64
) -> DataFrame:
    """(item_id, doc_id, cosine, run, lcs_share, answer_share) of documents that hold an item in other words.

    ``lcs_share``: longest common subsequence of item and stretch by the item's length, at least ``least``; ``answer_share``: share of
    the item's numbers in the stretch (1 without numbers).
    """
    result = documents.sparkSession.createDataFrame([], f"{LEAKS}, answer_share double")
    for sequences, own, idf, basis in _blocks(documents, items, doc_id, doc_text, item_id, item_text, 8, rank):
        result = result.unionByName(_paraphrases_of(sequences, own, idf, basis, cosine, least))
    return result
