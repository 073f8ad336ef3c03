"""Fill-in-the-middle transformation: a text is cut at two unit bounds and its parts change places.

An Arrow-batched pandas UDF finds the ends of all units (lines by default) with one pass of the regex
library and keeps them in a compact array, so the two cuts are two lookups and two slices of the whole text.
The cuts and the form come from SHA-256 of a seed and doc_id, so a row's result depends on nothing else and a
lost task gives the same again. A second UDF rebuilds the text from output and form alone.

Rows: null text counts as empty. An empty text, and one that holds a mark, stays plain, so the marks of an
output are always its first, and it can be undone. A null doc_id has an empty decimal. Rows that repeat a
doc_id get the cuts of that id for their own text. ``fill_middle`` carries all columns; those with the names
it adds (``ADDED``) are replaced. A text is held whole by one task, some times over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The ends of the units of ``text``, after a leading 0."""
    ends = array("Q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers below 2^32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(text: str, doc_id: object, unit: regex.Pattern, seed: int, rate: int, spm_rate: int) -> tuple:
    """The values of ``ADDED`` for one text."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(x in text for x in MARKS):
        form, sizes, output = "plain", (None, None), text
    else:
        low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        sizes = len(prefix), len(middle)
        if h4 % 100 < spm_rate:
            form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        else:
            form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, *sizes, output, hashlib.sha256(output.encode()).hexdigest()


def rebuilt(output: str, form: str) -> str:
    """The text that gave ``output``."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES) -> DataFrame:
    """The rows of ``docs`` with n (units), form, prefix_chars, middle_chars, output and output_sha256.

    ``rate`` of 100 texts are transformed, and ``spm_rate`` of 100 of those put the suffix first.
    """
    pattern = regex.compile(unit)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def transform(text: pd.Series, doc_id: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, d, pattern, seed, rate, spm_rate) for t, d in zip(text, doc_id, strict=True)]
        return pd.DataFrame(rows, columns=list(ADDED)).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    carried = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in ADDED]
    # ids go as text: whole numbers with a null among them would reach pandas as floats
    made = transform(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string"))
    return docs.select(*carried, made.alias("__made")).select(*carried, *(F.col(f"__made.{c}") for c in ADDED))


def restored(output: Column, form: Column) -> Column:
    """Struct of text and sha256: the text rebuilt from an output and its form."""

    @F.pandas_udf("text string, sha256 string")
    def restore(output: pd.Series, form: pd.Series) -> pd.DataFrame:
        texts = [rebuilt(o, f) for o, f in zip(output, form, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})

    return restore(output, form)
