"""Same or near-same records across splits (problem 5).

Method: weighted cosine join. A text is a vector of its distinct terms; the square of a term's weight rises with its inverse document
frequency from 1 to ``SPREAD``, so rare terms count more. Inverted lists of both splits are joined; exact dot products decide.

Terms are ordered from rare to common. Of each vector only a head is listed: the shortest one for which the squared norm of the
residual plus the square of the greatest weight stays below the wanted cosine. By Cauchy's inequality two vectors whose heads share
at most one term cannot reach it. So a rare term of a head has a list of its own, and common terms are listed by pairs of two; long
texts have rare heads, so their rows grow with their length and not with its square. In the join of the lists the
weights of the listed terms and the residual norms behind them bound the dot product of texts that share nothing rarer, and prune. With a
wanted Jaccard similarity the odd sketches of the word sets prune, too, without loss. Long lists are compared in tiles.

Document frequencies are counted over all texts of both splits, in 2 ** ``BUCKETS`` hash classes, which bounds what is broadcast; words
that share a class share its count. Weights and order only have to be the same on both sides, so the result stays exact.

Any Jaccard similarity t implies a cosine of at least 1 / (1 + SPREAD * (1 / t - 1) / 2) for weights within these limits, so overlaps
by Jaccard are joined at that cosine and then checked exactly.

Defined cases: null, empty and short texts are in no pair; copies are expanded from classes of equal word sets;
an empty side gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.llm.setjoin import expand, membership, odd_sketches, sketches_allow, stored_classes, with_sets, word_sets
from lintang.operators.tiles import in_tiles, tile_pairs
from lintang.session import materialize

BUCKETS = 18
SPREAD = 2.0
#: A term whose class stands in at most so many texts has a list of its own.
RARE = 64
#: Words of 64 bits of an odd sketch.
SKETCH = 4


def cosine_of(jaccard: float) -> float:
    """Least cosine of two vectors whose term sets have the given Jaccard similarity."""
    return 1 / (1 + SPREAD * (1 / jaccard - 1) / 2)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def document_counts(classes: DataFrame) -> np.ndarray:
    """Number of texts per hash class of terms, over all members of (members, hashes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << BUCKETS)
        for batch in batches:
            if len(batch):
                sizes = batch["hashes"].map(len).to_numpy()
                found = buckets_of(np.concatenate(batch["hashes"].to_numpy()).astype(np.int64))
                counts += np.bincount(found, np.repeat(batch["members"].to_numpy(), sizes), 1 << BUCKETS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at, "n": counts[at].astype(np.int64)})

    counted = materialize(classes.select("members", "hashes").mapInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))).toPandas()
    out = np.zeros(1 << BUCKETS)
    out[counted["bucket"].to_numpy(int)] = counted["n"]  # at most 2 ** BUCKETS rows
    return out


def squared_weights(counts: np.ndarray) -> np.ndarray:
    """Square of the weight per hash class, from 1 (in every text) to SPREAD (in one)."""
    total = max(counts.max(initial=0.0), 2.0)
    return 1 + (SPREAD - 1) * (1 - np.log(np.maximum(counts, 1)) / math.log(total))


def heads_of(hashes: np.ndarray, counts: np.ndarray, squares: np.ndarray, cosine: float, small: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list keys, squared norm of the terms in the key, squared norm behind the last of them) of a text, of unit length."""
    bucket = buckets_of(hashes)
    order = np.lexsort((hashes, counts[bucket]))
    mass = squares[bucket][order]
    mass = mass / mass.sum()
    behind = np.maximum(1 - np.cumsum(mass), 0.0)
    enough = np.flatnonzero(behind + mass.max() < cosine - 1e-9)
    size = int(enough[0]) + 1 if len(enough) and len(hashes) > small else len(hashes)
    terms = hashes[order][:size].view(np.uint64)
    rare = int(np.searchsorted(counts[bucket][order][:size], RARE, "right"))
    alone = size if len(hashes) <= small else rare  # in so short a text one shared term may be enough
    i, j = np.triu_indices(size - rare, 1)
    i, j = i + rare, j + rare
    pairs = ((terms[i] * np.uint64(0xD6E8FEB86659FD93)) ^ (terms[j] + (terms[i] >> np.uint64(7)))).view(np.int64)
    return np.concatenate((terms[:alone].view(np.int64), pairs)), np.concatenate((mass[:alone], mass[i] + mass[j])), np.concatenate((behind[:alone], behind[j]))


def inverted_lists(rows: DataFrame, shared, cosine: float, small: float, sketch: int = 0) -> DataFrame:
    """(list_key, rep, origin, n, own, rest, s0, s1, ..): norms of the listed terms and of what is behind them; odd sketches of ``sketch`` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, squares = shared.value
        for batch in batches:
            reps, origins, texts, keys, owns, rests = [], [], [], [], [], []
            held = 0

            def full() -> pd.DataFrame:
                lengths = [len(k) for k in keys]
                repeat = lambda values: np.repeat(np.array(values, dtype=np.int64), lengths)
                out = pd.DataFrame({"list_key": np.concatenate(keys), "rep": repeat(reps), "origin": repeat(origins), "n": repeat([len(t) for t in texts]), "own": np.sqrt(np.concatenate(owns)), "rest": np.sqrt(np.concatenate(rests))})
                sketches = odd_sketches(texts, sketch) if sketch else None
                return out.assign(**{f"s{i}": np.repeat(sketches[:, i], lengths) for i in range(sketch)})

            for rep, origin, hashes in zip(batch["rep"], batch["origin"], batch["hashes"]):
                text = np.asarray(hashes, dtype=np.int64)
                key, own, rest = heads_of(text, counts, squares, cosine, small)
                reps.append(rep), origins.append(origin), texts.append(text), keys.append(key), owns.append(own), rests.append(rest)
                held += len(key)
                if held > 100_000:
                    yield full()
                    reps, origins, texts, keys, owns, rests, held = [], [], [], [], [], [], 0
            if keys:
                yield full()

    words = "".join(f", s{i} bigint" for i in range(sketch))
    return rows.select("rep", "origin", "hashes").mapInPandas(run, f"list_key bigint, rep bigint, origin int, n int, own float, rest float{words}")


def cosine_join_pairs(
    left: DataFrame, right: DataFrame, cosine: float, jaccard: float | None = None, tile: int | None = None, sampled: int | None = None
) -> DataFrame:
    """(a, b, members_a, members_b, cosine, similarity) of the classes of both sides with at least that cosine (and Jaccard).

    With ``jaccard`` the sizes and the odd sketches of the texts prune, too.
    """
    spark = left.sparkSession
    both = left.select("rep", "members", "hashes", F.lit(0).alias("origin")).unionByName(right.select("rep", "members", "hashes", F.lit(1).alias("origin")))
    counts = document_counts(both)
    shared = spark.sparkContext.broadcast((counts, squared_weights(counts)))
    small = 2 * SPREAD / (cosine * (jaccard or cosine)) + 1
    listed = in_tiles(both, lambda rows: inverted_lists(rows, shared, cosine, small, SKETCH if jaccard else 0), tile, sampled)
    a, b = listed.where("origin = 0").alias("a"), listed.where("origin = 1").alias("b")
    # for the first terms that two texts share nothing else is common up to the last of them
    close = tile_pairs() & (F.col("a.own") * F.col("b.own") + F.col("a.rest") * F.col("b.rest") >= cosine - 1e-5)
    if jaccard:
        close = close & sketches_allow(jaccard, SKETCH)
    met = a.join(b, close).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = shared.value[1]
        for batch in batches:
            if not len(batch):
                continue
            owner, terms, norms = [], [], []
            for side in ("hashes_a", "hashes_b"):
                sizes = batch[side].map(len).to_numpy()
                flat = np.concatenate(batch[side].to_numpy()).astype(np.int64)
                rows = np.repeat(np.arange(len(batch)), sizes)
                owner.append(rows), terms.append(flat)
                norms.append(np.bincount(rows, squares[buckets_of(flat)], len(batch)))
            rows, flat = np.concatenate(owner), np.concatenate(terms)
            order = np.lexsort((flat, rows))
            rows, flat = rows[order], flat[order]
            twice = np.flatnonzero((rows[1:] == rows[:-1]) & (flat[1:] == flat[:-1]))
            dots = np.bincount(rows[twice], squares[buckets_of(flat[twice])], len(batch)) / np.sqrt(norms[0] * norms[1])
            out = batch[["a", "b", "members_a", "members_b"]].assign(cosine=dots, similarity=batch["similarity"])
            yield out[out["cosine"] >= cosine - 1e-9]

    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    union = F.size("hashes_a") + F.size("hashes_b") - F.col("common")
    checked = with_sets(met, left, right).withColumn("common", common).where(F.col("common") >= (jaccard or 0.0) * union)
    schema = "a bigint, b bigint, members_a bigint, members_b bigint, cosine double, similarity double"
    return checked.withColumn("similarity", F.col("common") / union).mapInPandas(products, schema)


def cross_split_overlaps(
    evaluation: DataFrame,
    training: DataFrame,
    evaluation_id: str,
    training_id: str,
    evaluation_text: Column,
    training_text: Column,
    threshold: float = 0.8,
    min_words: int = 1,
) -> DataFrame:
    """(id_a, id_b, similarity): every evaluation row with each training row of Jaccard similarity >= threshold."""
    left_sets, left = stored_classes(word_sets(evaluation, evaluation_id, evaluation_text, min_words))
    right_sets, right = stored_classes(word_sets(training, training_id, training_text, min_words))
    pairs = materialize(cosine_join_pairs(left, right, cosine_of(threshold), threshold))
    return expand(pairs, membership(left_sets, left), membership(right_sets, right))


def chat_question(messages: Column) -> Column:
    """The first user message behind its first ``Soal:``, or the whole message if it has none."""
    user = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]
    return F.when(F.instr(user, "Soal:") > 0, F.substr(user, F.instr(user, "Soal:") + 5)).otherwise(user)
