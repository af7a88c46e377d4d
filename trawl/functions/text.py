"""Text as Column expressions, so that everything stays in generated JVM code.

``fold`` works on a translation table made from the Unicode data of this Python:
compatibility forms of one character and combining marks below U+10000. Forms
that become several characters (ligatures, Hangul) are left to ``fold_exact``,
an Arrow function with the whole definition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic letters in Latin script, and legal forms that don't tell companies apart.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya i yi ye g".split(), strict=True))
LEGAL = (
    "llc ltd limited inc incorporated co corp corporation company plc sa sas sarl srl spa bv nv gmbh ag kg ab as oy "
    "ooo oao zao pao ao jsc pjsc ojsc cjsc fzco fze fzc tov pte pty sdn bhd llp lp joint stock public open closed "
    "liability obshchestvo ogranichennoy ogranichennoi otvetstvennostyu aktsionernoe publichnoe zakrytoe otkrytoe the of and"
).split()


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def fold_table() -> tuple[str, str]:
    """Characters and what they become; those beyond the second string's end are dropped."""
    pairs, dropped = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        p = _plain(c)
        if not p:
            dropped.append(c)
        elif len(p) == 1 and p != c:
            pairs.append((c, p))
    return "".join(a for a, _ in pairs) + "".join(dropped), "".join(b for _, b in pairs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def unmarked(text: Column) -> Column:
    """Without accents and compatibility forms. Plain ASCII, which has none, is let through: the table is looked up for each character."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.translate(text, *fold_table()))


def fold(text: Column) -> Column:
    """Without accents and compatibility forms, in lower case, white space squeezed."""
    return squeeze(F.lower(unmarked(text)))


@F.pandas_udf(T.StringType())
def fold_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda s: None if s is None else " ".join(_plain(s).lower().split()))


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text; an empty array for null. White space needs no squeezing here."""
    return F.coalesce(F.regexp_extract_all(F.lower(unmarked(text)), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the folded text, with repeats; a space counts as ``_``."""
    none = F.array().cast("array<string>")

    def cut(folded: Column) -> Column:
        last = F.length(folded) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(folded, k, F.lit(n)))).otherwise(none)

    return F.coalesce(let(F.replace(fold(text), F.lit(" "), F.lit("_")), cut), none)


def transliterate(text: Column) -> Column:
    """Lower case, Cyrillic in Latin letters."""
    out = F.lower(text)
    for letter, latin in CYRILLIC.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = [(a, b) for a, b in CYRILLIC.items() if len(b) == 1 and b != "-"]
    gone = [a for a, b in CYRILLIC.items() if b == "-"]
    return F.translate(out, "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single))


def normalise(name: Column) -> Column:
    """The words of a name without its legal form; if that is all it has, with it."""

    def without(spaced: Column) -> Column:
        own = F.filter(F.split(spaced, " +"), lambda w: (w != "") & ~w.isin(LEGAL))
        return F.coalesce(F.nullif(F.array_join(own, " "), F.lit("")), F.trim(spaced))

    return let(F.regexp_replace(fold(transliterate(name)), "[^a-z0-9 ]+", " "), without)


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays as sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def coverage(query: Column, doc: Column) -> Column:
    """Share of the query's distinct words that the other has."""
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, doc)) / n).otherwise(F.lit(0.0))


def first_of(properties: Column, key: str) -> Column:
    return F.try_element_at(properties[key], F.lit(1))


def safe_name(caption: Column, limit: int = 100) -> Column:
    """A name that file systems take and a link can aim at."""
    clean = F.trim(F.regexp_replace(caption, r'[\\/:*?"<>|#^\[\]\n\r\t]+', " "), F.lit(" ."))
    cut = F.rtrim(F.substring(F.regexp_replace(clean, r"(?U)\s+", " "), 1, limit), F.lit(" ."))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unnamed"))


def tag(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.trim(F.regexp_replace(F.lower(value), r"(?U)[^\w/-]+", "-"), F.lit("-")))


CITATION = r"\[([A-Za-z0-9][\w.:-]{2,})\]"


def cited(text: Column) -> Column:
    """Distinct ids in square brackets, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + CITATION), F.lit(1)))


def check_citations(text: Column, seen: Column) -> tuple[Column, Column]:
    """The ids that a text cites: those that were retrieved, and the others."""
    ids = cited(text)
    return F.filter(ids, lambda x: F.array_contains(seen, x)), F.filter(ids, lambda x: ~F.array_contains(seen, x))


def uncited_lines(text: Column, header: bool = True) -> Column:
    """Lines without a citation, but for those that end in a colon and, with ``header``, the first."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.trim(s, F.lit("- "))))
    some = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))) if header else lines
    return F.filter(some, lambda s: (s != "") & ~F.contains(s, F.lit("[")) & ~F.endswith(s, F.lit(":")))


def noisy(name: Column, key: Column, seed: int = 0) -> Column:
    """One inner character dropped from a name over six long, and two neighbours swapped twice if over four; places from a hash of ``key``."""

    def place(step: int, n: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(step)), n).cast("int")

    def shorter(text: Column) -> Column:
        n = F.length(text)
        return let(place(0, F.greatest(n - 2, F.lit(1))) + 2, lambda at: F.when(n > 6, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, n))).otherwise(text))

    def swapped(step: int) -> Callable[[Column], Column]:
        def swap(text: Column) -> Column:
            n = F.length(text)
            return let(place(step, F.greatest(n - 1, F.lit(1))) + 1, lambda i: F.when(n > 4, F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1)), F.substring(text, i, F.lit(1)), F.substring(text, i + 2, n))).otherwise(text))

        return swap

    return let(let(let(name, shorter), swapped(1)), swapped(2))


# The same on the driver, for single strings.


def fold_one(text: str) -> str:
    return " ".join(_plain(text).lower().split())


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", fold_one(text))
