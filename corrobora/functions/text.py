"""String measures and key functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digraphs and letters of the phonetic key, in order.
PHONETIC = [("PH", "F"), ("GH", "G"), ("KH", "K"), ("BH", "B"), ("DH", "D"), ("TH", "T"), ("CH", "C"), ("SH", "S"), ("CK", "K"), ("Q", "K"), ("X", "KS"), ("W", "V"), ("Y", "I"), ("J", "Z")]


def struct_of(columns: str) -> T.StructType:
    """The type of "name kind, ..." without a session."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in map(str.split, columns.split(", "))])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance, null as empty; with a ceiling, ``most + 1`` stands for anything beyond it."""
    if most is None:
        return F.levenshtein(blank(a), blank(b))
    d = F.levenshtein(blank(a), blank(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(blank(a)), F.length(blank(b)))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - levenshtein(a, b) / n)


def phonetic_key(x: Column) -> Column:
    """Letters folded by sound; vowels after the first letter go, repeats collapse."""
    x = F.regexp_replace(F.upper(blank(x)), "[^A-Z]", "")
    x = reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), PHONETIC, x)
    x = F.concat(F.left(x, F.lit(1)), F.regexp_replace(F.substr(x, F.lit(2)), "[AEIOU]", ""))
    return F.regexp_replace(x, r"(.)\1+", "$1")


def bigrams(x: Column) -> Column:
    x = F.regexp_replace(F.upper(blank(x)), r"\s+", "")
    at = F.when(F.length(x) > 1, F.sequence(F.lit(1), F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(x, i, F.lit(2))))


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice overlap of distinct bigrams; 1 if both have none, 0 if one has none."""
    x, y = bigrams(a), bigrams(b)
    n, m = F.size(x), F.size(y)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (n + m))


def overlap(x: Column, y: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 if one is empty."""
    x, y = F.array_distinct(x), F.array_distinct(y)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def squash(x: Column) -> Column:
    """Upper case, only ASCII letters, digits and Devanagari left."""
    return F.regexp_replace(F.upper(blank(x)), "[^A-Z0-9ऀ-ॿ]", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(blank(x), "[^0-9]", "")


def mask(x: Column) -> Column:
    """All but the last four characters hidden, eight stars at most; four or fewer become ``****``."""
    x = F.regexp_replace(blank(x), r"\s+", "")
    return F.when(F.length(x) <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), F.least(F.length(x) - 4, F.lit(8))), F.right(x, F.lit(4))))


def redact(text: Column, numbers: Column) -> Column:
    """``text`` with each of ``numbers`` masked, longest first; blank ones are passed over."""
    longest = F.array_sort(F.filter(numbers, lambda n: F.length(F.trim(n)) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, blank(text), lambda s, n: F.replace(s, n, mask(n)))


def redact_all(value: Column, schema: str, numbers: Column) -> Column:
    """Every string inside a nested value with ``numbers`` masked; the value keeps its shape."""
    return F.from_json(redact(F.to_json(value), numbers), schema)


def extraction_key(content_hash: Column, extractor: str, prompt: str, schema: str, models: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", blank(content_hash), *map(F.lit, (extractor, prompt, schema, ",".join(models)))), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for null, empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)
