"""Garbled text from wrong character encoding (problem 3).

Method: best-first graph search. A state is a stretch of text; its edges encode it in a character set and
decode the bytes as UTF-8, or resolve escapes. States come off a heap by their plausibility cost and are visited
once (by hash); no edge makes a text longer, so the search ends by itself, and the cheapest reachable text is the restoration. The search starts only at stretches with
characters that can stem from a wrong decoding, so clean text costs one regular expression.

A field is affected if a stretch reaches a cheaper text, or if it holds signs of a decoding that cannot be
undone: U+FFFD, C1 control characters, or a broken lead of a multi-byte sequence.

Defined cases: null, empty and pure ASCII texts are unaffected; genuine foreign letters and signs reach no cheaper
text and stay; any length of text is searched stretch by stretch; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintang.session import spread

#: Character sets in which UTF-8 is read by mistake.
CODECS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "cp866", "koi8_r", "iso8859_15", "gbk", "shift_jis", "big5")
#: One character of four bytes, read wrongly three times over, is no longer than this; a longer piece is several restorable ones.
PIECE = 36

#: What a stretch may be; Python and Java read the pattern alike, so it also tells which rows are searched.
#: Escapes with ``=`` are upper-case by definition; in lower case they would be equations such as x=ca=ab.
SEARCHED = (
    r"[^\x00-\x7f]+|&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[a-zA-Z][a-zA-Z0-9]{1,31});|(?:\\u[0-9a-fA-F]{4})+"
    r"|(?:%[89a-fA-F][0-9a-fA-F]){2,}|(?:=[89A-F][0-9A-F]){2,}"
)
STRETCH = re.compile(SEARCHED)
LOST = re.compile("[�\x80-\x9f]|锟斤拷")
#: First characters of a UTF-8 sequence that was read in a Western set, with what must follow.
BROKEN = re.compile("â[€‚„‰ˆ‹Œ™œ\x80-\x9f]|[ÃÂ][\x80-\x9f‚ƒ„…†‡ˆ‰‹œ]")


def character_cost(ch: str) -> float:
    """Cost of one character: letters of plain text are cheap, signs dearer, remains of a wrong decoding dearest."""
    code = ord(ch)
    if code < 0x80:
        return 1.0 if ch.isprintable() or ch in "\n\t" else 6.0
    if ch == "�" or 0x80 <= code <= 0x9F:
        return 9.0
    if code == 0xA0 or code == 0xAD:
        return 4.0
    if 0x2500 <= code <= 0x259F:
        return 4.5
    if 0x0400 <= code <= 0x04FF:
        return 4.0
    if ch.isalpha():
        return 3.0
    return 3.5


def plausibility_cost(text: str) -> float:
    """Sum of the character costs plus a charge for mixed scripts and signs next to each other."""
    cost = sum(map(character_cost, text))
    for a, b in zip(text, text[1:]):
        if ord(a) > 0x7F and ord(b) > 0x7F and (a.isalpha() != b.isalpha() or a.isupper() != b.isupper()):
            cost += 1.0
    return cost


def _single_bytes(text: str, codec: str) -> bytes | None:
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if codec in ("cp1252", "cp1251") and 0x80 <= ord(ch) <= 0x9F:  # bytes that the set leaves undefined
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def neighbours(text: str) -> Iterator[str]:
    for codec in CODECS:
        data = _single_bytes(text, codec)
        if data is None or all(b < 0x80 for b in data):
            continue
        try:
            fixed = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(fixed) <= len(text):
            yield fixed
    if "&" in text:
        yield html.unescape(text)
    if "\\u" in text:
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for sign in "%=":
        if sign in text:
            data = re.sub(rb"[%=]([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]), text.encode())
            try:
                yield data.decode("utf-8")
            except UnicodeDecodeError:
                pass


def restore_stretch(text: str) -> str:
    """Cheapest text reachable from the stretch; the stretch itself if nothing cheaper is reachable."""
    best, best_cost = text, plausibility_cost(text)
    heap, seen = [(best_cost, text)], {text}
    while heap:
        cost, state = heapq.heappop(heap)
        if cost < best_cost:
            best, best_cost = state, cost
        for other in neighbours(state):
            if other not in seen:
                seen.add(other)
                heapq.heappush(heap, (plausibility_cost(other), other))
    return best


class Restorer:
    """Restores texts, remembering stretches; the memory is bounded."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def stretch(self, text: str) -> str:
        found = self.known.get(text)
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            # a long stretch of foreign script is restored in pieces of whole words where it has spaces
            found = self.known[text] = restore_stretch(text)
            if found == text and len(text) > 1:
                found = self.known[text] = self.pieces(text)
        return found

    def pieces(self, text: str) -> str:
        """Garbled and intact signs side by side: restore the longest restorable piece from each position."""
        out, at = [], 0
        while at < len(text):
            for end in range(min(len(text), at + PIECE), at + 1, -1):
                fixed = restore_stretch(text[at:end])
                if fixed != text[at:end]:
                    out.append(fixed)
                    at = end
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def text(self, text: str | None) -> tuple[str | None, bool]:
        """(restored text, whether a stretch is garbled)."""
        if not text:
            return text, False
        garbled = bool(LOST.search(text))

        def fix(match: re.Match) -> str:
            nonlocal garbled
            before = match.group()
            after = self.stretch(before)
            if after != before or BROKEN.search(before):
                garbled = True
            return after

        return STRETCH.sub(fix, text), garbled


def restored_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, original, restored) of the fields with a garbled stretch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer()
        for batch in batches:
            rows = []
            for field in fields:
                for row_id, text in zip(batch["row_id"], batch[f"f_{field}"]):
                    fixed, garbled = restorer.text(text)
                    if garbled:
                        rows.append((row_id, field, text, fixed))
            yield pd.DataFrame(rows, columns=["id", "field", "original", "restored"])

    suspicious = reduce(or_, (F.col(f"f_{f}").rlike(SEARCHED) for f in fields))
    rows = spread(df.select(F.col(id_col).cast("bigint").alias("row_id"), *[F.col(f).alias(f"f_{f}") for f in fields]))
    return rows.where(suspicious).mapInPandas(run, "id bigint, field string, original string, restored string")
