"""Column expressions over text: words, identifier parts, search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
MOST_TERMS, LEAST_BYTES = 32, 2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def identifier_parts(token: Column) -> Column:
    """Parts in lower case, cut where a lower-case letter meets an upper-case one, a letter a digit, or a digit a letter, and at anything else."""
    cut = F.regexp_replace(token, r"(?<=[a-z])(?=[A-Z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])|[^a-zA-Z0-9]+", " ")
    return F.filter(F.split(F.lower(cut), " "), lambda p: p != "")


def search_text(text: Column) -> Column:
    """Each word followed by those of its parts that differ from it."""
    return F.array_join(F.flatten(F.transform(tokens(text), lambda t: F.concat(F.array(t), F.filter(identifier_parts(t), lambda p: p != t)))), " ")


def query_terms(text: Column) -> Column:
    """The first distinct words of at least two bytes."""
    long = F.filter(F.split(search_text(text), " "), lambda t: F.octet_length(t) >= LEAST_BYTES)
    return F.slice(F.array_distinct(long), 1, MOST_TERMS)


def query_string(text: Column) -> Column:
    terms = query_terms(text)
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR "))
