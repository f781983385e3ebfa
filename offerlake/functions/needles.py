"""Many words looked for in one pass over a text.

A normalised text is marked at each word boundary, once (`text.marked`). A needle between boundaries is then a plain
string, with marks at the same places. Each needle is filed under its longest word. The words of a text are looked up in
that hash set, and only the needles filed under words that the text has are compared with it. So the cost grows with the
text, not with the needles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import MARK, once, table


def anchor(form: str) -> str:
    """The longest whole word of a needle in its marked form, empty if it has none."""
    return max((w for w in form.split(MARK) if re.fullmatch(r"\w+", w)), key=lambda w: (len(w), w), default="")


def held_in(marks: Column, needles: Iterable[tuple[int, str]]) -> Column:
    """The numbers of the needles (number, marked form) that a marked text holds: array<int>, each once, in order."""
    filed: dict[str, list[dict]] = {}
    for number, form in needles:
        filed.setdefault(anchor(form), []).append({"number": number, "form": form})
    loose = filed.pop("", [])  # no word at all: compared with every text

    def numbers(m: Column) -> Column:
        hit = lambda own: F.transform(F.filter(own, lambda n: F.contains(m, n["form"])), lambda n: n["number"])
        parts = [hit(table(loose))] if loose else []
        if filed:
            words = F.array_distinct(F.filter(F.split(m, MARK), lambda w: w.isin(list(filed))))
            by_word = F.map_from_entries(table([{"word": w, "own": own} for w, own in filed.items()]))
            parts.append(F.flatten(F.transform(words, lambda w: hit(F.try_element_at(by_word, w)))))
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    return once(marks, numbers) if loose or filed else F.array().cast("array<int>")


def holds(key: Column, marks: Column, n: Column) -> Column:
    """Does a text, plain and marked, hold a needle (`text.needle`) of a literal table?"""
    return F.contains(F.when(n["short"], marks).otherwise(key), n["form"])


def times_of(text: Column, form: str | Column) -> Column:
    """How often a text holds a form, from left to right without overlaps."""
    form = F.lit(form) if isinstance(form, str) else form
    return ((F.octet_length(text) - F.octet_length(F.replace(text, form, F.lit("")))) / F.octet_length(form)).cast("int")


def times(key: Column, marks: Column, n: Column) -> Column:
    """How often a text, plain and marked, holds a needle of a literal table."""
    return once(F.when(n["short"], marks).otherwise(key), lambda x: F.when(F.contains(x, n["form"]), times_of(x, n["form"])).otherwise(0))
