"""Words of a text as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Everything in ASCII that is no digit and no lower-case letter.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; none for NULL."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BETWEEN_WORDS), ""), F.array().cast("array<string>"))


def with_words(docs: DataFrame, *keep: str | Column, name: str = "w") -> DataFrame:
    """``keep`` columns and the words of ``text``, split once a row.

    The generator keeps the optimizer from copying the split into expressions that visit each word.
    """
    return docs.select(*keep, F.explode(F.array(words(F.col("text")))).alias(name))
