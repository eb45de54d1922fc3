"""Broken prompt and response pairs (problem 6).

Method: a character n-gram naive Bayes, trained on rows labelled with a language, gives the language posteriors of
prompt and response, which are compared; languages outside the training set show by a likelihood far below what
known languages reach. Truncation is found by the likelihood of the last tokens under an end-of-text n-gram model
against their likelihood inside a text, both counted over all responses. Empty answers, refusals and copies of
the prompt are found by their text.

A row has at most one defect, in the order empty, refusal, copy, truncated, language.

Defined cases: a missing, null or blank response is empty; a null prompt cannot be copied and counts as the most
frequent language; a bare final result is sound; a phrase of refusal beside a result or an equation of the response's own
does not make a refusal; very long texts are read whole, labelled ones too; an empty table gives no rows.
The language of lines below ``LEAST_LETTERS`` letters and of answers below twice as many is not told: so few letters are
mostly names and units. Tails beyond the ``MOST_TAILS`` most frequent ones are judged by their last one or two tokens.
The language model counts all labelled rows and the lines of all pairs whose language the labels tell; its floor is read from
the likelihood of all these lines. Grams are counted in the tasks; the driver gets one count per language and gram, so the model
in memory grows with the letters of the languages and not with the rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.operators.sampling import bounded_top, ranked
from lintang.session import materialize, release, ship, spread

#: A task hands its counts on and begins anew when it holds so many different words.
MOST_WORDS = 100_000
MOST_TAILS = 50_000
LEAST_LETTERS = 8

#: Ways to decline, in the languages of the corpus; matched anywhere in a response without a solution.
REFUSALS = re.compile(
    r"\b(?:saya|jawaban|permintaan|yang ini|soal ini|tugas ini|pertanyaan ini|kami|aku)\b[^.\n]{0,40}\b(?:tidak|tak|belum|nggak|gak|enggak)\s+"
    r"(?:bisa|dapat|mampu|diizinkan|boleh|bersedia|sanggup)\b"
    r"|\bmemilih untuk tidak\b|\b(?:saya|harus)\s+menolak\b|\bdi luar kemampuan\b|\bmelanggar (?:pedoman|aturan|kebijakan)\b"
    r"|\bI(?:'m| am|’m)?\s+(?:sorry|unable|not able|afraid)\b|\bI\s+(?:can(?:'|’)?t|cannot|can not|won(?:'|’)t|will not|must decline|have to decline)\b"
    r"|\b(?:unable|not able) to (?:help|assist|solve|answer)\b|\bas an? (?:AI|language model)\b"
    r"|\b(?:lo siento|je suis désolé|es tut mir leid|desculpe|xin lỗi)\b|抱歉|无法(?:回答|提供)",
    re.I,
)
MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\boxed\{[^\n]*|\\[a-zA-Z]+|[\d_^{}=+*/|<>~]+", re.S)
EQUATION = re.compile(r"[^\s=$]+\s*=\s*[^\s=$]+")
LABEL = re.compile(r"^[\s>*]*(?:berikut soalnya|soal|pertanyaan|jawaban|question|problem|answer|q|a)\s*[:：]\s*", re.I)
#: The part of MATH that holds letters.
FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\boxed\{[^\n]*|\\[a-zA-Z]+", re.S)
PLAIN = bytes(b | 32 if chr(b).isalpha() and b < 128 else 32 for b in range(256))
COMMAND, LETTERS, NUMBER, SHAPE = re.compile(r"\\[a-zA-Z]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\S")
BARE_BOX = re.compile(r"\s*\$*\\boxed\{[\w ,./{}-]*\w[\w ,./{}-]*\}\$*\.?\s*")
WORD = re.compile(r"[^\W_]+")
LINE = re.compile(r"\n+|(?<=[.!?。]) ")


def is_empty(answer: str | None) -> bool:
    """Nothing besides white space, invisible characters, punctuation or empty wrappers."""
    if not answer:
        return True
    left = re.sub(r"</?[a-zA-Z]+\s*/?>", "", answer)
    before = None
    while before != left:
        before = left
        left = re.sub(r"\\[a-zA-Z]+\s*\{[^\w\\]*\}|\\[\[\]()]", "", left)
    return not re.search(r"[^\W_]", left)


def final_result(answer: str) -> bool:
    """A closed, non-empty box."""
    at = answer.rfind("\\boxed")
    if at < 0:
        return False
    start = answer.find("{", at)
    if start < 0:
        return False
    depth = 0
    for i in range(start, len(answer)):
        depth += (answer[i] == "{") - (answer[i] == "}")
        if depth == 0:
            return bool(re.search(r"\w", answer[start : i + 1]))
    return False


def is_worked(prompt: str | None, answer: str) -> bool:
    """An equation of its own, which the prompt does not have."""
    asked = "".join((prompt or "").split())
    return any("".join(found.split()).rstrip(".,;:!?") not in asked for found in EQUATION.findall(answer))


def is_copy(prompt: str | None, answer: str) -> bool:
    """The prompt again, whole or nearly, with hardly any word of its own."""
    if not prompt:
        return False
    asked, said = Counter(WORD.findall(prompt.lower())), Counter(WORD.findall(LABEL.sub("", answer).lower()))
    size, common = sum(said.values()), sum((asked & said).values())
    return size >= 3 and common >= 0.8 * size and common >= 0.6 * sum(asked.values())


def tail(answer: str, length: int = 3) -> tuple[str, ...]:
    """Last tokens: words become w, numbers 0, LaTeX commands go, marks stay."""
    shapes = SHAPE.findall(NUMBER.sub("0", LETTERS.sub("w", COMMAND.sub(" ", answer[-160:]))))
    return tuple(["", "", *shapes][-length:])


@dataclass
class PairModel:
    languages: dict[str, LanguageModel]
    floor: float
    major: str
    ends: dict[tuple[str, ...], int]
    inner: dict[tuple[str, ...], int]
    end_total: int
    inner_total: int
    joint: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def main_language(self, text: str, only_known: bool = False) -> tuple[str, int]:
        """(language of most letters, number of letters); remarks in brackets do not count."""
        names, share, fit, total = list(self.languages), {}, 0.0, 0
        for line in LINE.split(MATH.sub(" ", text)) if names else ():
            bare = line.strip()
            if bare.startswith("(") and bare.endswith(")"):
                continue
            words = LETTERS.findall(bare.lower())
            letters = sum(map(len, words))
            if not bare.isascii():
                letters += 2 * sum(ord(ch) > 0x2E80 for ch in bare)
            if letters >= LEAST_LETTERS:
                sums = [sum(x) for x in zip(*map(self.scores, words))]
                best = max(range(len(sums)), key=sums.__getitem__)
                share[names[best]] = share.get(names[best], 0) + letters
                fit += letters * sums[best] / (sum(map(len, words)) + len(words))
                total += letters
        if not share:
            return "", 0
        best = max(share, key=share.__getitem__)
        if not only_known and fit / total < self.floor:
            return "other", total
        return best, total if share[best] * 2 > total else 0

    def scores(self, word: str) -> tuple[float, ...]:
        """Score of the word in each language; remembered, within a bound."""
        found = self.joint.get(word)
        if found is None:
            if len(self.joint) > 200_000:
                self.joint.clear()
            found = self.joint[word] = tuple(m.word(word) for m in self.languages.values())
        return found

    def end_ratio(self, answer: str) -> float:
        """Log ratio of the tail's likelihood at the end of a text and inside one, longest counted tail first."""
        whole = tail(answer)
        for length in range(len(whole), 0, -1):
            part = whole[-length:]
            ends, inner = self.ends.get(part, 0), self.inner.get(part, 0)
            if ends + inner >= 200 or length == 1:
                return math.log((ends + 0.5) / (self.end_total + 1)) - math.log((inner + 0.5) / (self.inner_total + 1))
        return 0.0

    def is_truncated(self, answer: str) -> bool:
        if final_result(answer):
            return False
        bare = answer.rstrip()
        opened = bare.count("{") > bare.count("}") or bare.count("$") % 2 == 1
        if opened:
            return True
        if re.fullmatch(r"[\s$\\(\[]*[-+]?[\d.,/ ]+(?:\s*(?:sisa\s+\d+|%|[a-zA-Z²³]{1,6}))?[\s$\\)\].]*", bare):
            return False  # a bare result
        if re.search(r"[.!?。]['\"”’)\]*]*$", bare):
            return False
        return self.end_ratio(bare) < 0

    def defect(self, prompt: str | None, answer: str | None) -> str | None:
        if is_empty(answer):
            return "empty"
        if BARE_BOX.fullmatch(answer) and answer.count("{") == answer.count("}"):
            return None  # a bare final result
        done = final_result(answer)
        if not done and REFUSALS.search(answer) and not is_worked(prompt, answer):
            return "refusal"
        if not done and is_copy(prompt, answer):
            return "copy"
        if self.is_truncated(answer):
            return "truncated"
        spoken, letters = self.main_language(answer)
        if letters >= 2 * LEAST_LETTERS:
            asked = self.main_language(prompt or "", only_known=True)[0] or self.major
            if spoken != asked:
                return "language"
        return None


def plain_letters(text: str) -> str:
    """Lower-case letters and single spaces, without mathematics."""
    if "$" in text or "\\" in text:
        text = FORMULA.sub(" ", text)
    if text.isascii():
        return " ".join(text.encode().translate(PLAIN).decode().split())
    if "\n" in text:
        return " ".join(filter(None, map(plain_line, text.split("\n"))))
    return plain_line(text)


def plain_line(line: str) -> str:
    if line.isascii():
        return " ".join(line.encode().translate(PLAIN).decode().split())
    return " ".join(LETTERS.findall(line.lower()))


def leading_grams(words: Counter[str]) -> Counter[str]:
    """Counts of the trigrams of padded words and of the bigrams that begin them; ``all_grams`` has the others."""
    found: Counter[str] = Counter()
    for word, times in words.items():
        padded = f" {word} "
        found[padded[:2]] += times
        for gram in map(add, map(add, padded, padded[1:]), padded[2:]):
            found[gram] += times
    return found


def all_grams(found: Counter[str]) -> Counter[str]:
    """Adds the bigrams and single characters that the grams end in; the empty gram counts all characters, and one."""
    out = Counter(found)
    for gram, times in found.items():
        if len(gram) == 3:
            out[gram[1:]] += times
        else:
            out[gram[0]] += times
        out[gram[-1]] += times
        out[""] += times * (4 - len(gram))
    out[""] += 1
    return out


class Memo(dict):
    """Values of a function, remembered within a bound."""

    def __init__(self, function: Callable[[str], float], most: int) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key: str) -> float:
        if len(self) > self.most:
            self.clear()
        found = self[key] = self.function(key)
        return found


class LanguageModel:
    """Character trigrams within padded words, interpolated with bigrams, single characters and a floor."""

    def __init__(self, texts: Iterable[str] = (), counts: Counter[str] | None = None) -> None:
        words: Counter[str] = Counter()
        for text in texts:
            words.update(text.split())
        self.__setstate__(all_grams(leading_grams(words) + (counts or Counter())))

    def end(self, gram: str) -> float:
        """Log probability of the last character of a trigram, or of the bigram that begins a word."""
        counts, two, one = self.counts, gram[-2:], gram[-1]
        return math.log(
            0.6 * counts.get(gram, 0) / max(counts.get(gram[:-1], 0), 1)
            + 0.3 * counts.get(two, 0) / max(counts.get(two[:1], 0), 1)
            + 0.095 * counts.get(one, 0) / counts[""]
            + 0.00005
        )

    def word(self, word: str) -> float:
        """Log probability of a word and the space behind it."""
        padded = f" {word} "
        return sum(map(self.ends.__getitem__, map(add, map(add, padded, padded[1:]), padded[2:])), self.ends[padded[:2]])

    def score(self, words: list[str], size: int) -> float:
        """Mean log probability of a character of a line of so many; the classes have equal priors."""
        return sum(map(self.known.__getitem__, words)) / (size + 1)

    def __getstate__(self) -> Counter[str]:
        return self.counts

    def __setstate__(self, counts: Counter[str]) -> None:
        self.counts, self.ends, self.known = counts, Memo(self.end, 200_000), Memo(self.word, 100_000)


def pieces(text: str) -> list[str]:
    """Letters of the lines and sentences that have enough of them."""
    for mark in ".!?。":
        text = text.replace(f"{mark} ", f"{mark}\n")
    return [plain for p in text.split("\n") if len(plain := plain_letters(p)) >= 12]


def best_language(models: dict[str, LanguageModel], plain: str) -> tuple[str, bool, float]:
    """(most likely language, whether it is far ahead, its mean log probability) of the letters of a line."""
    words = plain.split()
    scores = sorted([(m.score(words, len(plain)), name) for name, m in models.items()], reverse=True)
    return scores[0][1], len(scores) == 1 or scores[0][0] - scores[1][0] > 0.25, scores[0][0]


def told_lines(models: dict[str, LanguageModel], floor: float, prompt: str, answer: str | None) -> tuple[str, list[str]]:
    """(language of the prompt, its lines in that language, and those of the answer if most of them are in it, too).

    Lines below the floor are in none of the languages and would teach a model foreign words.
    """
    asked = [(plain, *best_language(models, plain)) for plain in pieces(prompt)]
    votes = Counter(name for _, name, sure, _ in asked if sure)
    if not votes:
        return "", []
    major = votes.most_common(1)[0][0]
    kept = [plain for plain, name, sure, score in asked if sure and name == major and score >= floor]
    replied = [(plain, *best_language(models, plain)) for plain in pieces(answer or "")]
    same = [plain for plain, name, _, score in replied if name == major and score >= floor]
    return major, kept + same if 2 * len(same) > len(replied) else kept


def gram_rows(words: dict[str, Counter[str]]) -> pd.DataFrame:
    rows = [(lang, gram, n) for lang, found in words.items() for gram, n in leading_grams(found).items()]
    return pd.DataFrame(rows, columns=["lang", "gram", "n"])


def gram_counts(parts: DataFrame) -> dict[str, Counter[str]]:
    """Leading grams of each language, from the counts (lang, gram, n) of the tasks."""
    found: dict[str, Counter[str]] = defaultdict(Counter)
    summed = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    for name, gram, n in zip(*(summed[c].to_pylist() for c in ("lang", "gram", "n"))):
        found[name][gram] = n
    return found


def language_model(
    labelled: DataFrame, text: str, lang: str, same: dict[str, str], prompts: DataFrame | None = None
) -> tuple[dict[str, LanguageModel], float, str]:
    """A model per language, the floor that known languages reach, and the most frequent language.

    ``same`` joins labels that stand for closely related languages. The lines of ``prompts`` (prompt, answer), whose
    language the first models tell, widen the vocabulary of that language.
    """
    names = F.coalesce(*[F.when(F.col(lang) == a, F.lit(b)) for a, b in same.items()], F.col(lang)) if same else F.col(lang)
    rows = spread(labelled.where(F.col(lang).isNotNull() & (F.length(text) > 40)).select(names.alias("lang"), F.col(text).alias("text")), 1)

    def label_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for name, written in zip(batch["lang"], batch["text"]):
                words[name].update(plain_letters(written).split())
            if sum(map(len, words.values())) > MOST_WORDS:
                yield gram_rows(words)
                words.clear()
        yield gram_rows(words)

    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}, -99.0, ""
    counted = gram_counts(rows.mapInPandas(label_grams, "lang string, gram string, n bigint"))
    models = {name: LanguageModel(counts=counted[name]) for name in sorted(counts)}

    def floor_of(texts: DataFrame, lines: Callable[[str], list[str]]) -> float:
        shared = ship(labelled.sparkSession, models)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared()
            for batch in batches:
                scores = [best_language(known, line)[2] for whole in batch.iloc[:, 0] for line in lines(whole) if line]
                yield pd.DataFrame({"score": scores}, dtype="float64")

        scores = materialize(texts.mapInPandas(run, "score double"))
        total = scores.count()
        floor = ranked(scores, "score", total // 500) - 0.4 if total else -99.0
        release(scores)
        return floor

    floor = floor_of(rows.select("text"), lambda whole: [plain_letters(whole)])
    if prompts is not None:
        first, least = ship(labelled.sparkSession, models), floor

        def told_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = first()
            words: dict[str, Counter[str]] = defaultdict(Counter)
            for batch in batches:
                found = [told_lines(known, least, p, a) for p, a in zip(batch["prompt"], batch["answer"])]
                for name, kept in found:
                    for plain in kept:
                        words[name].update(plain.split())
                lines = [(name, "\n".join(kept)) for name, kept in found if kept]
                yield pd.DataFrame(lines, columns=["lang", "lines"]).assign(gram=None, n=0)[["lang", "gram", "n", "lines"]]
                if sum(map(len, words.values())) > MOST_WORDS:
                    yield gram_rows(words).assign(lines=None)
                    words.clear()
            yield gram_rows(words).assign(lines=None)

        asked = prompts.where(F.length("prompt") > 40).select("prompt", "answer")
        told = materialize(asked.mapInPandas(told_grams, "lang string, gram string, n bigint, lines string"))
        further = gram_counts(told.where(F.col("gram").isNotNull()))
        if further:
            models = {name: LanguageModel(counts=counted[name] + further[name]) for name in models}
            floor = floor_of(told.where(F.col("lines").isNotNull()).select("lines"), lambda whole: whole.split("\n"))
        release(told)
    return models, floor, max(sorted(counts), key=counts.__getitem__)


def end_model(pairs: DataFrame) -> tuple[dict, dict, int, int]:
    """Counts of the last 1 to 3 token shapes at the end of, and inside, all responses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: Counter = Counter()
        inner: Counter = Counter()
        for batch in batches:
            for answer in batch["answer"]:
                if answer:
                    shapes = NUMBER.sub("0", LETTERS.sub("w", COMMAND.sub(" ", answer.rstrip())))
                    shapes = ["", "", *SHAPE.findall(shapes)]
                    triples = list(zip(shapes, shapes[1:], shapes[2:]))
                    if triples:
                        ends[triples[-1]] += 1
                        inner.update(triples[:-1])
        rows = [("end", "\t".join(k), v) for k, v in ends.items()] + [("inner", "\t".join(k), v) for k, v in inner.items()]
        yield pd.DataFrame(rows, columns=["place", "tail", "n"])

    counted = pairs.select("answer").mapInPandas(run, "place string, tail string, n bigint").groupBy("place", "tail").agg(F.sum("n").alias("n"))
    rows = bounded_top(counted, "n", MOST_TAILS).collect()
    tails: dict[str, Counter] = {"end": Counter(), "inner": Counter()}
    for r in rows:
        whole = tuple(r["tail"].split("\t"))
        for n in (1, 2, 3):  # shorter tails are sums of longer ones
            tails[r["place"]][whole[-n:]] += r["n"]
    total = lambda c: sum(v for k, v in c.items() if len(k) == 1)
    return dict(tails["end"]), dict(tails["inner"]), total(tails["end"]), total(tails["inner"])


def pair_model(pairs: DataFrame, labelled: DataFrame, text: str, lang: str, same: dict[str, str] = {}) -> PairModel:  # noqa: B006
    languages, floor, major = language_model(labelled, text, lang, same, pairs)
    ends, inner, end_total, inner_total = end_model(pairs)
    return PairModel(languages, floor, major, ends, inner, end_total, inner_total)


def defective_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(tbl, row_id, defect) of the defective rows of (tbl, row_id, prompt, answer)."""
    shared = ship(pairs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared()
        for batch in batches:
            found = [judge.defect(p, a) for p, a in zip(batch["prompt"], batch["answer"])]
            out = batch.assign(defect=found)[["tbl", "row_id", "defect"]]
            yield out[out["defect"].notna()]

    return pairs.mapInPandas(run, "tbl string, row_id bigint, defect string")


def prompt_answer_pairs(chat: DataFrame, correct: DataFrame, question: Column) -> DataFrame:
    """(tbl, row_id, prompt, answer) of both tables; the answer is the last assistant message."""
    said = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    a = chat.select(F.lit("chatml").alias("tbl"), F.col("chat_id").alias("row_id"), question.alias("prompt"), said.alias("answer"))
    b = correct.select(F.lit("correct").alias("tbl"), F.col("corr_id").alias("row_id"), F.col("soal").alias("prompt"), F.col("text").alias("answer"))
    return spread(a.unionByName(b))
