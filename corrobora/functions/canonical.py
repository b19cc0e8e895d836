"""JSON of which there is one form: keys in order, no spaces, numbers as a browser writes them."""

from __future__ import annotations

import json
from decimal import Decimal


def number(x: int | float) -> str:
    """As ECMAScript prints a number: the fewest digits, no exponent from 1e-6 to 1e21; what is no number is null."""
    if isinstance(x, int):
        if abs(x) <= 2**53:
            return str(x)
        x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        body = text + "0" * (point - len(text)) if point >= len(text) else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = f"0.{'0' * -point}{text}"
    else:
        body = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if sign else "") + body


def canonical(value) -> str:
    """``value`` (dicts, lists, strings, numbers, booleans, None) in its one form. Keys stand in the order of UTF-16."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number(value)
    return json.dumps(value, ensure_ascii=False)
