"""Boxed results, answer normalisation and answer equivalence."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintang.functions.predicates import text_or_empty, trimmed

DEPTH = 4
LAST_NUMBER = r"-?\d+(?:[.,]\d+)?"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated a single time, however often it is used; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), 0)


def balanced(depth: int = DEPTH) -> str:
    """Pattern of a text whose braces are balanced down to ``depth`` levels."""
    pattern = r"[^{}]*+"
    for _ in range(depth):
        pattern = rf"[^{{}}]*+(?:\{{{pattern}\}}[^{{}}]*+)*+"
    return pattern


def _scanned(after: Column) -> Column:
    """Text inside the first brace by counting braces, to any depth; null if it is never closed."""

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = s["at"] + 1
        first = F.when((s["first"] == 0) & (ch == "{"), at).otherwise(s["first"])
        last = F.when((s["last"] == 0) & (first > 0) & (depth == 0), at).otherwise(s["last"])
        return F.struct(depth.alias("depth"), at.alias("at"), first.alias("first"), last.alias("last"))

    start = F.struct(*[F.lit(0).alias(n) for n in ("depth", "at", "first", "last")])
    return F.aggregate(F.split(after, ""), start, step, lambda e: F.when(e["last"] > 0, F.substring(after, e["first"] + 1, e["last"] - e["first"] - 1)))


def _boxed(text: Column, lead: str) -> Column:
    """A pattern reads boxes of a few levels; braces are counted only where a deeper one follows.

    No function of a function is used here: Python functions cannot take such columns.
    """
    shallow, after = rf"(?s)^{lead}\{{({balanced()})\}}", F.substring_index(text, "\\boxed", -1)
    found = once(after, lambda a: F.when(a.rlike(shallow), F.regexp_extract(a, shallow, 1)))
    deep = (F.length(after) - F.length(F.replace(after, F.lit("{"), F.lit(""))) > DEPTH) & after.rlike(rf"^{lead}\{{")
    return F.when(text.contains("\\boxed"), F.coalesce(found, F.when(deep, _scanned(after))))


def extract_boxed(text: Column) -> Column:
    """Body of the last ``\\boxed{...}`` with only white space before the brace; null if there is none or it is open."""
    return _boxed(text, r"\s*")


def extract_boxed_loose(text: Column) -> Column:
    """As ``extract_boxed``, but any characters may stand before the brace, and the body is trimmed."""
    return F.regexp_replace(_boxed(text, r"[^{]*"), r"^\s+|\s+$", "")


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text_or_empty(text), F.lit(LAST_NUMBER), F.lit(0)), F.lit(-1))


def extract_answer(text: Column) -> Column:
    return F.coalesce(extract_boxed(text), last_number(text))


def answer_from_steps(text: Column) -> Column:
    """Boxed body, else the last ``$...$`` span, else the last number."""
    span = F.try_element_at(F.regexp_extract_all(text_or_empty(text), F.lit(r"\$([^$]+)\$"), F.lit(1)), F.lit(-1))
    return F.coalesce(extract_boxed(text), span, last_number(text))


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_latex_delimiters(c: Column) -> Column:
    return _chain(
        trimmed(c), (r"\\[()\[\]]", ""), (r"\$", ""), (r"\\[dt]frac", r"\\frac"), (r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "($1)/($2)"), (r"^\s+|\s+$", "")
    )


def normalize_answer_text(c: Column) -> Column:
    """The ordered normalisation of the grader; null becomes empty. The order of the steps is a fixed value."""
    return F.lower(
        _chain(
            strip_latex_delimiters(c),
            (r"\\(?:text|mathrm|mbox|operatorname)\s*\{([^{}]*)\}", "$1"),
            (r"\\(?:left|right|,|;|!|quad|qquad)", ""),
            (r"^\s*[A-Ea-e][.)]\s+(?=\S)", ""),
            (r"^[A-Za-z]'?\s*=\s*", ""),
            (r"\\(?:cdot|times)", "*"),
            (r"\\%", "%"),
            (r"\((-?\d+(?:\.\d+)?)\)", "$1"),
            (" ", ""),
            (r"(?<=\d),(?=\d{3}\b)", ""),
            (r"(?<=\d),(?=\d)", "."),
            (r"\.+$", ""),
        )
    )


def normalize_answer_loose(c: Column) -> Column:
    """The normalisation of rejection sampling: inner box, spacing macros, all white space, decimal comma."""
    def normal(text: Column) -> Column:
        inner = _chain(
            F.coalesce(extract_boxed_loose(text), text), (r"^\s+|\s+$", ""), (r"^\$+|\$+$", ""), (r"^\s+|\s+$", ""), (r"\\[!,;]", ""), (r"\\ ", " "),
            (r"\\(?:left|right)", ""), (r"\\[dt]frac", r"\\frac"), (r"\{,\}", "."), (r"\.+$", ""), (r"\s+", ""),
        )
        return once(inner, lambda x: F.lower(F.when(x.rlike(r"^-?\d+,\d+$"), F.replace(x, F.lit(","), F.lit("."))).otherwise(x)))

    return once(trimmed(c), normal)


def to_number(c: Column) -> Column:
    """Fraction, decimal number or number with unit as a double, else null."""
    bare = F.regexp_replace(F.trim(c), "%+$", "")
    top, bottom = (F.regexp_extract(bare, r"^([-+]?\d+)/(\d+)$", g).cast("double") for g in (1, 2))
    unit = F.regexp_replace(F.regexp_extract(bare, r"^\s*(-?\d+(?:[.,]\d+)?)\s*[a-zA-Z%°]*\s*$", 1), ",", ".")
    return (
        F.when(bare.rlike(r"^[-+]?\d+/\d+$"), F.try_divide(top, bottom))
        .when(bare.rlike(r"(?i)^\s*[-+]?(\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?\s*$"), F.trim(bare).try_cast("double"))
        .when(unit != "", unit.try_cast("double"))
    )


def numeric_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    x, y = to_number(a), to_number(b)
    return F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(y)), F.lit(False))


def quick_match(prediction: Column, gold: Column) -> Column:
    """Equal after normalisation, or numerically; null or empty sides never match."""
    sides = F.struct(normalize_answer_text(prediction).alias("p"), normalize_answer_text(gold).alias("g"))
    return prediction.isNotNull() & once(sides, lambda s: (s["g"] != "") & ((s["p"] == s["g"]) | numeric_equal(s["p"], s["g"])))


class _Expression:
    """Evaluates an arithmetic text with letters at a random point modulo a large prime, for an identity test."""

    PRIME = (1 << 61) - 1

    def __init__(self, text: str, values: dict[str, int]) -> None:
        self.tokens = re.findall(r"\d+\.\d+|\d+|[a-z]|[-+*/^()=,{}\[\]]", text.replace("**", "^"))
        if "".join(self.tokens) != re.sub(r"\s+", "", text.replace("**", "^")):
            raise ValueError("unknown sign")
        self.at, self.values = 0, values

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def value(self) -> tuple:
        parts = [self.sum()]
        while self.peek() == ",":
            self.at += 1
            parts.append(self.sum())
        if self.at < len(self.tokens):
            raise ValueError("left over")
        return tuple(parts)

    def sum(self) -> int:
        sign = 1
        if self.peek() in ("+", "-"):
            sign = -1 if self.peek() == "-" else 1
            self.at += 1
        total = sign * self.product()
        while self.peek() in ("+", "-"):
            sign = -1 if self.peek() == "-" else 1
            self.at += 1
            total += sign * self.product()
        return total % self.PRIME

    def product(self) -> int:
        total = self.power()
        while (t := self.peek()) and (t in "*/(" or t.isalnum()):
            if t in "*/":
                self.at += 1
            factor = self.power()
            total = total * (pow(factor, -1, self.PRIME) if t == "/" else factor) % self.PRIME
        return total

    def power(self) -> int:
        base = self.atom()
        if self.peek() == "^":
            self.at += 1
            sign = 1
            if self.peek() == "-":
                sign, self.at = -1, self.at + 1
            exponent = self.peek()
            if not exponent.isdigit():
                raise ValueError("exponent")
            self.at += 1
            base = pow(base, sign * int(exponent), self.PRIME)
        return base

    def atom(self) -> int:
        token = self.peek()
        self.at += 1
        if token == "(":
            inner = self.sum()
            if self.peek() != ")":
                raise ValueError("open")
            self.at += 1
            return inner
        if token.isalpha():
            return self.values.setdefault(token, random.Random(token).randrange(2, self.PRIME))
        number = Fraction(token)
        return number.numerator * pow(number.denominator, -1, self.PRIME) % self.PRIME


def symbolic_equal(a: str | None, b: str | None) -> bool:
    """Identity test of two expressions with implicit multiplication; False if one cannot be read."""
    try:
        sides = []
        for text in (a, b):
            plain = re.sub(r"\\(?:cdot|times)", "*", re.sub(r"\\[()\[\]]|\$|\\left|\\right|\s", "", text or ""))
            plain = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", plain).replace("{", "(").replace("}", ")").lower()
            plain = re.sub(r"^[a-z]'?=", "", plain)
            if not plain:
                return False
            sides.append(_Expression(plain[1:-1] if plain.startswith("(") and "," in plain and plain.endswith(")") else plain, {}).value())
        return sides[0] == sides[1]
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return False


def symbolic_match(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([symbolic_equal(p, q) for p, q in zip(x, y)], dtype=bool)

    return run(a, b)


def graded(df: DataFrame, prediction: str, gold: str, out: str = "correct", symbolic: bool = True) -> DataFrame:
    """Adds ``out``: whether the prediction is equivalent to the gold answer.

    Only unlike pairs of which a side looks like an expression reach the Python tier.
    """
    quick = df.withColumn("__quick", quick_match(F.col(prediction), F.col(gold)))
    if not symbolic:
        return quick.withColumnRenamed("__quick", out)
    sign = r"[a-zA-Z(^*/+\\]"
    expression = (F.col(prediction) != F.col(gold)) & (trimmed(F.col(gold)) != "") & (F.col(prediction).rlike(sign) | F.col(gold).rlike(sign))
    masked = lambda c: F.when(expression, F.col(c))
    return quick.withColumn(out, F.col("__quick") | symbolic_match(masked(prediction), masked(gold))).drop("__quick")


def answer_shape(c: Column) -> Column:
    s, n = trimmed(c), normalize_answer_text(c)
    words = F.regexp_replace(s, r"\\(?:text|mathrm|boxed)\s*\{[^{}]*\}", "")
    return (
        F.when(s == "", "empty").when(n.rlike(r"^-?\d+(?:\.\d+)?$"), "numeric").when(n.rlike(r"^-?\d+/\d+$"), "fraction")
        .when(s.contains(" ") & words.rlike("[A-Za-z]{4,}"), "text").otherwise("expr")
    )


def answer_type(c: Column) -> Column:
    j = trimmed(c)
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(j, r"^\.+|\.+$", ""), r"^\$+|\$+$", ""), r"^\s+|\s+$", "")
    return (
        F.when(j == "", "empty").when(core.rlike(r"^-?\d+$"), "pure_int").when(core.rlike(r"^-?\d+([./]\d+)?$"), "pure_num")
        .when(F.regexp_count(j, F.lit("[A-Za-z]{3,}")) <= 1, "single_expr")
        .when(j.contains("$") | j.contains("\\"), "sentence").otherwise("sentence_plain")
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product, without large factorials; k is clamped to n."""
    size = F.least(F.lit(k), n)
    missed = F.aggregate(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), F.lit(1.0), lambda acc, i: acc * (n - c - i) / F.greatest(n - i, F.lit(1))
    )
    return F.when((size <= 0) | (c <= 0), 0.0).when(n - c < size, 1.0).otherwise(1.0 - missed)
