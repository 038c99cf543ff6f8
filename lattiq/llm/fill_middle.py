"""Fill-in-the-middle: a text is cut at two of its units, and the part between goes to the end.

Units are matched twice by a lazy iterator: the first pass counts them, the second is advanced to the lesser and then
to the greater rank. Memory is that of the text and its output; no list of units or places is ever held.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import by_bytes, ship, texts

#: What a unit is, and the marks of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")


def units(text: str, unit: re.Pattern) -> int:
    """How many units a text has; the matches are counted as they come."""
    number = count()
    deque(zip(unit.finditer(text), number), maxlen=0)
    return next(number)


def cuts(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """The code points before the ends of the first and the second of two ranks (first <= second; rank 0 ends at 0)."""
    ends = map(re.Match.end, unit.finditer(text))
    a = next(islice(ends, first - 1, first)) if first else 0
    more = second - first
    return a, next(islice(ends, more - 1, more)) if more else a


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of eight hexadecimal digits of the SHA-256 of `seed:key`, as integers; a null key is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(n)]


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks are found again in any output only if none can begin inside another or itself."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or any(b.startswith(a[k:]) or a[k:].startswith(b) for k in range(i == j, len(a))):
                raise ValueError(f"the marks {marks} can overlap")


def transform(spark: SparkSession, docs: DataFrame, key: str = "doc_id", seed: int = 1, plain: int = 10, spm: int = 20, unit: str = UNIT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (code points; null if plain), output of every whole text.

    `plain` of 100 texts stay as they are, besides empty ones and those that hold a mark; of the rest `spm` of 100 put the
    suffix first. Both and the places of the cuts follow from the key and the seed alone. A null text counts as empty; repeated
    rows give equal rows; a null key is drawn as an empty one; an empty table gives an empty result; other columns play no part.
    """
    ship(spark)
    _checked(marks)
    p, s, m = marks
    rows = texts(docs, key)
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = re.compile(unit)

        def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            n = units(text, matcher)
            if not text or h3 % 100 >= 100 - plain or any(x in text for x in marks):
                return n, "plain", None, None, text
            a, b = cuts(text, matcher, *sorted((h1 % (n + 1), h2 % (n + 1))))
            if h4 % 100 < spm:
                return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
            return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

        for whole in batches:
            for b in by_bytes(whole):
                out = [one(*r) for r in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True)]
                n, form, before, middle, text = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(text, pa.string())], names=names)

    drawn = rows.select(F.col(key), "text", *(h.alias(f"_h{i}") for i, h in enumerate(draws(F.col(key), seed))))
    shape = f"`{key}` {rows.schema[key].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return drawn.mapInArrow(run, shape)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of transform() was made of, from output and form alone; null if one of them is null."""
    _checked(marks)

    def parts(first: str, second: str, third: str) -> list[Column]:
        a, b = F.locate(second, output), F.locate(third, output)
        begin = len(first) + 1
        return [F.substr(output, F.lit(begin), a - begin), F.substr(output, a + len(second), b - a - len(second)), F.substr(output, b + len(third))]

    p, s, m = marks
    prefix, suffix, middle = parts(p, s, m)
    suffix2, prefix2, middle2 = parts(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).when(form == "plain", output)


def digests(rows: DataFrame, key: str = "doc_id", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows of transform() with SHA-256 of the output and of the text restored from it in place of the output.

    A row for each row, repeated ones included; an empty table gives an empty result."""
    back = restored(F.col("output"), F.col("form"), marks)
    return rows.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
