"""Template residue and error-page text (problem 9).

Method: a linear classifier (logistic loss, L2) over hashed word n-grams, markup shapes, a title feature (first line) and the length
of the document. It scores windows of up to ``WINDOW`` tokens; a document is flagged if one window scores above zero, so a
residue inside a long text is found whatever stands around it.

Weak labels come from general signals only: HTTP states with their standard reason, program exceptions, template syntax, a word
repeated over and over, and a few common phrases. They say which stretch of a document is residue and, in a short
document, that the other lines probably are, too. From these lines the classifier learns what no label names; after a fit,
documents it is sure of leave the negatives and lend their windows (self-training), and the negatives' best windows are
mined. ``validation`` leaves out every second label and measures on hosts (sources) the fit has not seen how many of the
documents that only those labels know are found without them.

The fit uses at most ``MOST_LABELLED`` labelled and ``MOST_OTHER`` other documents, whole, out of ``MOST_SEEN`` that are chosen by hash and
labelled; their weights restore the shares of the table. Every document is scored whole; tokens are cut and hashed in the JVM, windows are summed as arrays.

Defined cases: null, empty and blank texts are not flagged; repeated texts get the same answer; without a weak label nothing is
flagged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.operators.sampling import bounded_sample
from lintang.session import materialize, ship, spread

MOST_SEEN = 45_000
MOST_LABELLED = 4000
MOST_OTHER = 8000
BITS = 20
WINDOW = 8
SHORT = 400
LEAST_MARGIN = 1.0

#: Template syntax that was not filled in; not behind a LaTeX command or brace.
SHAPES = (
    ("curly", r"(?<![\\\w}{$])\{\{[#/^>]?\s*[A-Za-z_][\w.|\s]*\}\}"), ("block", r"\{%-?\s*\w[^%\n]{0,60}%\}"), ("dollar", r"(?<![\\\w])\$\{[A-Za-z_][\w.]*\}"),
    ("hash", r"#\{[A-Za-z_][\w.]*\}"), ("brace", r"(?<![\\\w}{$^_])\{(?:[A-Z][A-Z_]{3,}|[a-z]{2,}[A-Z]\w*)\}"), ("escaped", r"&lt;[a-zA-Z][\w ]{2,30}&gt;"), ("percent", r"%%?[A-Z][A-Z_]{2,}%%?|%\(\w+\)[sd]"),
    ("under", r"__[A-Z][A-Z_]{2,}__"), ("angle", r"<<?[A-Z][A-Z_]{2,}>>?|<[%?]=?[^%?\n]{1,40}[%?]>"), ("object", r"\[object \w+\]"),
    ("square", r"\[[A-Z][A-Z]+(?: [A-Z]+)+\]|\[\.\.[^\]\n]{1,40}\.\.\]|\[(?:insert|your|masukkan|sisipkan|isi|tulis)\b[^\]\n$=+\d]{0,40}\]"), ("model", r"@[Mm]odel\.\w+"), ("line", r"_{4,}\s*\((?:diisi|isi|fill|to be filled)\b"),
)
#: Weak labels, matched on lower-cased text in which shapes stand as words.
LABELS = (
    # template syntax and forms that were not filled in
    r"unfilled shapex[a-z]+x", r"\btodo:", r"\[[^\]\n]{0,40}(?:belum ada|di sini|here)\]", r"\b(?:halo|hai|hello|hi|dear) (?:undefined|null|nan)\b",
    # filler
    r"\blorem ipsum\b", r"\bdolor sit amet\b", r"\badipiscing elit\b", r"\beiusmod tempor\b", r"\bquis nostrud\b", r"\bullamco laboris\b",
    r"\b(?:dummy|placeholder|sample) text\b", r"\b(?:teks|paragraf|kalimat) (?:contoh|pengganti|isian|sementara)\b",
    r"\b(?P<one>[^\W\d]{3,}+)(?: (?P=one)\b){3,}", r"\b(?P<two>[^\W\d]{3,}+ [^\W\d]{3,}+)(?: (?P=two)\b){2,}",
    # response states and error pages
    r"\b[45][0-9]{2} (?:bad request|unauthorized|forbidden|not found|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    r"\b(?:page|halaman)(?: \w+){0,4} (?:not found|tidak (?:ditemukan|tersedia))\b", r"\b(?:access denied|akses ditolak)\b", r"\b(?:session|sesi)(?: \w+){0,3} (?:expired|berakhir)\b",
    r"\btimed out after [0-9]", r"\btraceback \(most recent call last\)", r"\b(?:fatal error|uncaught [a-z]*error):?", r"\b[a-z]+(?:\.[a-z]+)+exception\b", r"\bwarning: [a-z_]+\(\)",
    r"\bdatabase connection\b", r"\bserver (?:error|bermasalah)\b", r"\bkesalahan (?:pada )?server\b", r"\b(?:gagal memuat|failed to load)\b",
    r"\b(?:please try again|silakan (?:coba lagi|muat ulang))\b", r"\boops\b", r"\b(?:something went wrong|terjadi kesalahan|ada yang salah)\b", r"\b(?:no longer available|(?:sudah|telah) dihapus)\b",
    # notices that scripts are required
    r"\b(?:enable|activate|aktifkan|nyalakan|requires|membutuhkan|memerlukan) (?:javascript|scripts|skrip)\b", r"\bjavascript is (?:disabled|required)\b", r"<noscript>",
)
TOKEN = r"\n|[^\W\d_]+|\d+|_{2,}|[^\w\s]"
SIGNS = re.compile(r"[{\[%_<#@]|&lt;")
COMPILED = [(f" unfilled shapex{name}x ", re.compile(pattern)) for name, pattern in SHAPES]
NEWLINE = np.array([xxhash.xxh64_intdigest(b"\n", 42)], np.uint64).view(np.int64)[0]


def plain(text: str) -> str:
    """Lower-cased text with shapes as words and single line breaks; ``plain_column`` is the same in the JVM."""
    if SIGNS.search(text):
        for word, pattern in COMPILED:
            text = pattern.sub(word, text)
    return re.sub(r"\n+", "\n", text.lower())


def plain_column(text: Column) -> Column:
    shaped = text
    for name, pattern in SHAPES:
        shaped = F.regexp_replace(shaped, pattern, f" unfilled shapex{name}x ")
    return F.regexp_replace(F.lower(F.when(text.rlike(SIGNS.pattern), shaped).otherwise(text)), r"\n+", "\n")


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens of a plain text; all numbers count as 0."""
    cut = F.regexp_extract_all(F.regexp_replace(text, "[0-9]+", "0"), F.lit(r"\n|\p{L}+|\p{N}+|_{2,}|[^\p{L}\p{N}_\s]"), F.lit(0))
    return F.transform(cut, lambda t: F.xxhash64(t))


def _unquoted(pattern: str) -> str:
    """Not right behind a quotation mark: such texts speak about the phrase."""
    return f"(?<![\"“‘«'])(?:{pattern})"


#: One of these stands in every text with a label that has no repeated word.
SIGNALS = (
    "unfilled ", "todo:", "belum ada]", "di sini]", "here]", " undefined", " null", " nan", "lorem ipsum", "dolor sit amet", "adipiscing", "eiusmod", "nostrud", "ullamco", " text", "teks ", "paragraf ", "kalimat ", " bad ", "unauthorized", "forbidden", "not found", "too many requests", "internal server",
    "service ", "gateway time", "tidak ditemukan", "tidak tersedia", "access denied", "akses ditolak", "expired", "berakhir", "timed out after", "traceback (", "fatal error", "uncaught ", "exception", "warning: ", "database connection", "server error", "server bermasalah", "kesalahan ", "gagal memuat", "failed to load",
    "please try again", "silakan ", "oops", "went wrong", "yang salah", "no longer ", "dihapus", "javascript", "scripts", "skrip", "<noscript>",
)


def labels(without: int | None = None) -> str:
    """Pattern of the weak labels; without every second one, beginning with 0 or 1, for validation."""
    return _unquoted("|".join(p for k, p in enumerate(LABELS) if k % 2 != without))


@dataclass
class ResidueModel:
    weights: np.ndarray
    bias: float


class Tokens:
    """Token hashes of many documents end to end, and the feature numbers of every token, pair, title and length."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.starts = len(hashes), starts
        self.counts = np.diff(np.append(starts, self.n))
        self.doc = np.repeat(np.arange(len(starts)), self.counts)
        mixed = hashes.view(np.uint64)
        fold = np.uint64(64 - BITS)
        self.single = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> fold).astype(np.int32)
        pair = (mixed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[1:]) * np.uint64(0x9E3779B97F4A7C15)
        self.pair = np.append((pair >> fold).astype(np.int32), 0)
        self.line_end = hashes == NEWLINE
        if self.n:  # no pair goes over the end of a document
            last = starts[self.counts > 0] + self.counts[self.counts > 0] - 1
            self.closed = self.line_end.copy()
            self.closed[last] = True
            self.closed[:-1] |= self.line_end[1:]
        else:
            self.closed = self.line_end
        ends = np.cumsum(self.line_end)
        before = np.append(0, ends)[starts] if self.n else np.zeros(len(starts), int)
        self.title = (ends - before[self.doc]) == 0
        self.length = np.minimum(np.frexp(sizes.astype(float))[1], 13)

    def windows(self, model: ResidueModel) -> tuple[np.ndarray, np.ndarray]:
        """(best score, its number of tokens) of the windows that begin at each token, without bias and context."""
        w = model.weights
        single = np.where(self.line_end, -1e6, w[self.single])
        step = np.where(self.closed, -1e6, w[self.pair])
        best, size, total = single.copy(), np.ones(self.n, np.int8), single.copy()
        for k in range(1, WINDOW):
            if self.n <= k:
                break
            total[:-k] += step[k - 1 : self.n - 1] + single[k:]
            total[-k:] = -1e6
            better = total > best
            best[better] = total[better]
            size[better] = k + 1
        return best, size

    def context(self, model: ResidueModel) -> np.ndarray:
        return model.bias + np.where(self.title, model.weights[0], 0.0) + model.weights[1 + self.length][self.doc]

    def documents(self, model: ResidueModel) -> np.ndarray:
        """Best score of each document, minus infinity without tokens."""
        out = np.full(len(self.starts), -np.inf)
        if self.n:
            filled = self.counts > 0
            out[filled] = np.maximum.reduceat(self.windows(model)[0] + self.context(model), self.starts[filled])
        return out

    def features(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) entries of the windows of ``size`` tokens at ``at``."""
        rows = np.arange(len(at))
        spread_out = lambda n: (np.repeat(rows, n), np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        r1, p1 = spread_out(size)
        r2, p2 = spread_out(size - 1)
        title = self.title[at]
        length = 1 + self.length[self.doc[at]]
        return np.concatenate((r1, r2, rows[title], rows)), np.concatenate((self.single[p1], self.pair[p2], np.zeros(title.sum(), int), length))


def _descend(model: ResidueModel, row: np.ndarray, feature: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int, strength: float = 1e-6, context: float = 1e-3) -> ResidueModel:
    """Adaptive gradient descent of the weighted logistic loss with L2, whole matrix at a time."""
    used, feature = np.unique(feature, return_inverse=True)
    w, bias = model.weights[used].astype(float), model.bias
    penalty = np.where(used < 16, context, strength)  # the title and the length alone must not decide
    squares, bias_square = np.full(len(used), 3e-6), 3e-6
    for _ in range(steps):
        margin = np.clip(np.bincount(row, w[feature], len(label)) + bias, -30, 30)
        error = weight * (1 / (1 + np.exp(-margin)) - label)
        gradient = np.bincount(feature, error[row], len(used)) / weight.sum() + penalty * w
        squares += gradient * gradient
        w -= 0.3 * gradient / np.sqrt(squares)
        slope = error.sum() / weight.sum()
        bias_square += slope * slope
        bias -= 0.1 * slope / np.sqrt(bias_square)
    weights = model.weights.copy()
    weights[used] = w
    return ResidueModel(weights, float(bias))


def _tokens_of(originals: list[str]) -> tuple[Tokens, list[str], np.ndarray, np.ndarray]:
    """Tokens of texts, the plain texts, and the character spans of the tokens in them (for the labelled spans)."""
    texts = [plain(t) for t in originals]
    hashes, starts, first, last = [], [], [], []
    known: dict[str, int] = {}
    for text in texts:
        starts.append(len(hashes))
        for m in re.finditer(TOKEN, text):
            t = "0" if m.group()[0].isdigit() else m.group()
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42)
            hashes.append(known[t])
            first.append(m.start())
            last.append(m.end())
    sizes = np.array([len(t) for t in originals])
    return Tokens(np.array(hashes, np.uint64).view(np.int64), np.array(starts, int), sizes), texts, np.array(first, int), np.array(last, int)


def fit(sample: pd.DataFrame, without: int | None = None, rounds: int = 5) -> ResidueModel:
    """Model of a sample (text, weight, and label where it is known) of whole documents; every second label may be left out."""
    model = ResidueModel(np.zeros(1 << BITS), 0.0)
    share = sample["weight"].to_numpy(float)
    pattern = re.compile(labels(without))
    tokens, texts, first, last = _tokens_of(list(sample["text"]))
    if not tokens.n:
        return ResidueModel(model.weights, -1.0)
    marked = np.zeros(tokens.n, bool)
    strong_at, strong_size = [], []
    ends = tokens.starts + tokens.counts
    may_hold = sample["label"].to_numpy(bool) if "label" in sample else np.ones(len(texts), bool)
    for k in np.flatnonzero(may_hold):
        for m in pattern.finditer(texts[k]):
            a = tokens.starts[k] + int(np.searchsorted(last[tokens.starts[k] : ends[k]], m.start(), "right"))
            b = tokens.starts[k] + int(np.searchsorted(first[tokens.starts[k] : ends[k]], m.end(), "left"))
            if b > a:
                marked[a:b] = True
                strong_at += [a, a]
                strong_size += [min(b - a, WINDOW), min(b - a, 3)]
    labelled = np.bincount(tokens.doc, marked, len(texts)) > 0
    if not labelled.any():
        return ResidueModel(model.weights, -1.0)
    line = np.append(0, np.cumsum(tokens.line_end | np.append(np.diff(tokens.doc) > 0, False)))[:-1]
    line_start = np.flatnonzero(np.append(True, np.diff(line) > 0))
    line_size = np.diff(np.append(line_start, tokens.n)) - tokens.line_end[np.append(line_start[1:], tokens.n) - 1]
    line_doc = tokens.doc[line_start]
    short = np.array([len(t) <= SHORT for t in texts])
    rng = np.random.default_rng(3)

    def pieces(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that cover the given lines, half overlapping."""
        at = [np.arange(s, max(s + 1, s + n - WINDOW // 2), WINDOW // 2) for s, n in zip(line_start[lines], line_size[lines])]
        at, owner = np.concatenate([*at, np.zeros(0, int)]).astype(int), np.repeat(lines, [len(a) for a in at])
        return at, np.minimum(WINDOW, line_start[owner] + line_size[owner] - at)

    flagged = labelled.copy()
    mined = [(np.zeros(0, int), np.zeros(0, int))]
    learned = (np.zeros(0, int), np.zeros(0, int))
    for number in range(rounds):
        usable = line_size > 0
        weak_at, weak_size = pieces(np.flatnonzero(usable & (flagged & short)[line_doc]))
        clean = np.flatnonzero(usable & ~flagged[line_doc])
        offset = (rng.random(len(clean)) * np.maximum(line_size[clean] - WINDOW // 2, 1)).astype(int)
        clean_at = line_start[clean] + offset
        clean_size = np.minimum(rng.integers(1, WINDOW + 1, len(clean)), line_size[clean] - offset)
        best = tokens.windows(model)[0] + tokens.context(model)
        groups = [(np.array(strong_at), np.array(strong_size), 1, 2.0), (weak_at, weak_size, 1, 0.3), (*learned, 1, 0.5), (clean_at, clean_size, 0, 1.0)]
        keep = [~flagged[tokens.doc[a]] for a, _ in mined]
        groups += [(a[k], s[k], 0, 1.0) for (a, s), k in zip(mined, keep)]
        at = np.concatenate([g[0] for g in groups]).astype(int)
        size = np.concatenate([g[1] for g in groups]).astype(int)
        label = np.concatenate([np.full(len(g[0]), g[2]) for g in groups])
        weight = np.concatenate([np.full(len(g[0]), g[3]) for g in groups]) * share[tokens.doc[at]]
        model = _descend(model, *tokens.features(at, size), label, weight, 50 if number else 120)
        best, size = tokens.windows(model)
        best = best + tokens.context(model)
        # the best window of each line of a document without residue is a negative of the next round
        top = np.maximum.reduceat(best, line_start)
        hard = np.flatnonzero(usable & ~flagged[line_doc] & (top > -2.0))
        place = np.array([line_start[k] + int(best[line_start[k] : line_start[k] + line_size[k]].argmax()) for k in hard], int)
        if 0 < number < 3:
            sure = np.flatnonzero(top > LEAST_MARGIN)
            flagged = labelled | (np.bincount(line_doc[sure], minlength=len(texts)) > 0)
            where = np.array([line_start[k] + int(best[line_start[k] : line_start[k] + line_size[k]].argmax()) for k in sure if not labelled[line_doc[k]]], int)
            learned = (where, size[where].astype(int))
        mined.append((place, size[place].astype(int)))
    return model


def is_labelled(text: Column, without: int | None = None) -> Column:
    """Whether a plain text has a weak label of ``labels(without)``; the long pattern runs only where a signal word stands."""
    signal = F.lit(False)
    for word in SIGNALS:
        signal = signal | text.contains(word)
    repeated = r"\b([^\W\d]{3,}+)(?: \1\b){3,}|\b([^\W\d]{3,}+ [^\W\d]{3,}+)(?: \2\b){2,}"
    java = labels(without).replace("(?P<", "(?<").replace("(?P=one)", r"\k<one>").replace("(?P=two)", r"\k<two>")
    return (signal | text.rlike(repeated)) & text.rlike(java)


def sample_documents(documents: DataFrame, text_col: str, host_col: str, hosts: Column | None = None) -> pd.DataFrame:
    """(text, host, weight, label): bounded samples of labelled and other documents among ``MOST_SEEN``, weighted back to their shares."""
    rows = documents.select(F.col(text_col).alias("text"), F.col(host_col).alias("host")).where(F.col("text").rlike(r"\S"))
    if hosts is not None:
        rows = rows.where(hosts)
    share = min(1.0, MOST_SEEN / max(rows.count(), 1))
    seen = rows.where(F.pmod(F.xxhash64("text", "host", F.lit(29)), F.lit(1 << 40)) < int(share * (1 << 40)))
    seen = materialize(spread(seen, 1).withColumn("plain", plain_column(F.col("text"))).select("text", "host", is_labelled(F.col("plain")).alias("label")))
    counts = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    parts = []
    for label, most in ((True, MOST_LABELLED), (False, MOST_OTHER)):
        n = counts.get(label, 0)
        picked = bounded_sample(seen.where(F.col("label") == label).select("text", "host"), F.concat_ws("\n", "text", "host"), most, n).toPandas()
        parts.append(picked.assign(weight=n / max(len(picked), 1), label=label))
    scale = parts[0]["weight"].iloc[0] if len(parts[0]) else 1.0
    both = pd.concat(parts, ignore_index=True)
    return both.assign(weight=both["weight"] / scale)


def residue_model(documents: DataFrame, text_col: str = "text", host_col: str = "source") -> ResidueModel:
    return fit(sample_documents(documents, text_col, host_col))


def residue_scores(documents: DataFrame, id_col: str, text_col: str, model: ResidueModel) -> DataFrame:
    """(id, score) of every document; residue where score > 0."""
    shared = ship(documents.sparkSession, ResidueModel(model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("tokens")
                offsets = lists.offsets.to_numpy().astype(int)
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                scores = Tokens(flat, offsets[:-1] - offsets[0], part.column("size").to_numpy()).documents(known)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores)], names=["id", "score"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(documents.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")), 1)
    cut = rows.select("id", F.length("text").alias("size"), token_hashes(plain_column(F.col("text"))).alias("tokens"))
    return cut.mapInArrow(run, "id bigint, score double")


def scores_of(texts: list[str], model: ResidueModel) -> np.ndarray:
    return _tokens_of(texts)[0].documents(model)


def validation(documents: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(labels_left_out, documents, recall, recall_left_out, flagged_share) on hosts of a hash class that the fit has not seen.

    Every second label is left out of a fit; ``documents`` are those that only labels of that half know, ``recall`` is that of
    the full model and ``recall_left_out`` that of the fit, to which these documents were unlabelled. ``flagged_share`` is the
    share of documents without any label that the full model flags. All documents of those hosts are counted; the fits are those of ``fit``.
    """
    spark = documents.sparkSession
    host, text = F.coalesce(F.col("host"), F.lit("")), F.col("text")
    unseen = F.pmod(F.xxhash64(host, F.lit(9)), F.lit(4)) == 0
    train = sample_documents(documents, text_col, host_col, ~unseen)
    rows = documents.select(F.col(text_col).alias("text"), F.col(host_col).alias("host")).where(text.rlike(r"\S")).where(unseen)
    shown = rows.select("text", plain_column(text).alias("plain"))
    # known_0: by even labels, known_1: by odd ones
    test = materialize(shown.select(F.monotonically_increasing_id().alias("id"), "text", *[is_labelled(F.col("plain"), 1 - k).alias(f"known_{k}") for k in (0, 1)]))
    flagged = test.select("id", "known_0", "known_1")
    for name, without in (("full", None), ("blind_0", 0), ("blind_1", 1)):
        said = residue_scores(test, "id", "text", fit(train, without))
        flagged = flagged.join(said.select("id", (F.col("score") > 0).alias(name)), "id")
    other = ~F.col("known_0") & ~F.col("known_1")
    only = [F.col(f"known_{k}") & ~F.col(f"known_{1 - k}") for k in (0, 1)]
    sums = {"other": other, "other_full": other & F.col("full")}
    for k in (0, 1):
        sums |= {f"only_{k}": only[k], f"full_{k}": only[k] & F.col("full"), f"left_{k}": only[k] & F.col(f"blind_{k}")}
    n = flagged.agg(*[F.count_if(c).alias(name) for name, c in sums.items()]).first()
    share = n["other_full"] / max(n["other"], 1)
    out = [(name, n[f"only_{k}"], n[f"full_{k}"] / max(n[f"only_{k}"], 1), n[f"left_{k}"] / max(n[f"only_{k}"], 1), share) for k, name in ((0, "even"), (1, "odd"))]
    return spark.createDataFrame(out, "labels_left_out string, documents bigint, recall double, recall_left_out double, flagged_share double")
