"""Document numbers: check digits, formats, repair. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.constants import CONFUSIONS, FORMATS, SLOTS, TO_ALPHA, TO_DIGIT
from corrobora.functions.text import blank, digits, let


def dihedral() -> list[int]:
    """The multiplication table of the symmetries of a pentagon, flat: entry 10 a + b."""
    return [((a + b if a < 5 else a - b) % 5) + 5 * ((a < 5) != (b < 5)) for a in range(10) for b in range(10)]


def permutations() -> list[int]:
    """The position permutation and its powers, flat: entry 10 (i mod 8) + digit."""
    first, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        rows.append([first[d] for d in rows[-1]])
    return [v for r in rows for v in r]


def _checksum(x: Column, shift: int) -> Column:
    """The running product over the digits of ``x`` from the last, the last at place ``shift``."""
    digit = lambda tab, at: F.substr(F.lit("".join(map(str, tab))), at + 1, F.lit(1)).cast("int")
    at = F.when(F.length(x) > 0, F.sequence(F.lit(0), F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda c, i: digit(dihedral(), c * 10 + digit(permutations(), ((i + shift) % 8) * 10 + F.substr(x, F.length(x) - i, F.lit(1)).cast("int")))
    return F.aggregate(at, F.lit(0), step)


def verhoeff_valid(x: Column) -> Column:
    return let(digits(x), lambda d: (F.length(d) > 0) & (_checksum(d, 0) == 0))


def verhoeff_digit(x: Column) -> Column:
    inverse = [next(b for b in range(10) if dihedral()[10 * a + b] == 0) for a in range(10)]
    return F.get(F.array(*map(F.lit, inverse)), _checksum(digits(x), 1)).cast("string")


def mrz_check(x: Column) -> Column:
    """Weights 7, 3, 1 over digits, letters from 10 and fillers as 0; -1 if any other character occurs."""
    x = blank(x)
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = F.when(F.length(x) > 0, F.sequence(F.lit(0), F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(at, F.lit(0), lambda s, i: s + F.greatest(F.call_function("instr", alphabet, F.substr(x, i + 1, F.lit(1))) - 1, F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3 + 1))
    return F.when(x.rlike("[^A-Z0-9<]"), F.lit(-1)).otherwise(total % 10)


def mrz_date(x: Column, pivot: int, expiry: bool = False) -> Column:
    """YYMMDD as an ISO date; months and days are checked by range alone. Empty if it is no date."""
    yy, mm, dd = (F.substr(x, F.lit(i), F.lit(2)) for i in (1, 3, 5))
    century = F.lit("20") if expiry else F.when(yy.cast("int") > pivot, F.lit("19")).otherwise(F.lit("20"))
    return F.when(x.rlike("^[0-9]{6}$") & mm.between("01", "12") & dd.between("01", "31"), F.concat(century, yy, F.lit("-"), mm, F.lit("-"), dd)).otherwise(F.lit(""))


def canonical(x: Column) -> Column:
    return F.regexp_replace(F.upper(blank(x)), r"[\s/-]", "")


def number_reason(kind: Column, x: Column) -> Column:
    """Why a number fails its type: the first of unknown type, empty, not validated, length, pattern, checksum; '' if it passes."""
    return let(canonical(x), lambda v: _reason(kind, v))


def _reason(kind: Column, v: Column) -> Column:
    out = F.when(~kind.isin(*FORMATS) | kind.isNull(), F.lit("unknown_document_type")).when(v == "", F.lit("empty"))
    for name, (pattern, size, checked) in FORMATS.items():
        own = kind == name
        if pattern is None:
            out = out.when(own, F.lit("not_validated"))
            continue
        out = out.when(own & (F.length(v) != size), F.lit("wrong_length")).when(own & ~v.rlike(pattern), F.lit("pattern_mismatch"))
        if checked:
            out = out.when(own & ~verhoeff_valid(v), F.lit("checksum_failed"))
    return out.otherwise(F.lit(""))


def infer_type(x: Column) -> Column:
    return let(canonical(x), _infer)


def _infer(v: Column) -> Column:
    return F.when(v.rlike(FORMATS["pan"][0]), F.lit("pan")).when(v.rlike(FORMATS["passport"][0]), F.lit("passport")).when(v.rlike(FORMATS["voter"][0]), F.lit("voter")).when(v.rlike(FORMATS["aadhaar"][0]) & verhoeff_valid(v), F.lit("aadhaar")).otherwise(F.lit(""))


def repair_positional(kind: str, x: Column) -> Column:
    """Characters replaced by the look-alike that their slot allows, where the length fits; else the canonical value."""
    v, slots = canonical(x), SLOTS[kind]
    fold = lambda table, c: F.coalesce(F.create_map(*[F.lit(y) for p in table.items() for y in p])[c], c)
    parts = [fold(TO_ALPHA if s == "A" else TO_DIGIT, F.substr(v, F.lit(i + 1), F.lit(1))) for i, s in enumerate(slots)]
    return F.when(F.length(v) == len(slots), F.concat(*parts)).otherwise(v)


def repair_checksum(x: Column) -> Column:
    """The one valid number that a single digit confusion away makes; null if there is none or several."""
    return let(digits(x), _repair)


def _repair(v: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, many in CONFUSIONS.items() for b in many])
    at = F.when(F.length(v) > 0, F.sequence(F.lit(1), F.length(v))).otherwise(F.array().cast("array<int>"))
    own = lambda i: F.transform(F.filter(pairs, lambda p: p["a"] == F.substr(v, i, F.lit(1))), lambda p: F.concat(F.left(v, i - 1), p["b"], F.substr(v, i + 1)))
    good = lambda n: _checksum(n, 0) == 0
    return let(F.array_distinct(F.filter(F.flatten(F.transform(at, own)), good)), lambda valid: F.when(F.size(valid) == 1, F.get(valid, F.lit(0))))
