"""Settings: a file of KEY=value lines, under what the environment already says."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

#: Switches of the engine and what they are unless set.
SWITCHES = {"BULK_UPLOAD": True, "ENFORCE_CAPABILITIES": True, "ENFORCE_OWNERSHIP": True, "ENFORCE_BARRIER": True, "ISSUANCE_ENABLED": False}


def parse(text: str) -> dict[str, str]:
    """The settings of a file. A byte order mark, blank lines and lines that start with # are passed over; a value may be quoted."""
    out = {}
    for line in text.removeprefix("﻿").splitlines():
        if (m := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)) and not line.lstrip().startswith("#"):
            value = m[2]
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[m[1]] = value[1:-1] if quoted else value
    return out


def load(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """``into`` (the environment) with the settings of the file at ``path`` that it does not have yet. Without the file: as it is."""
    at = os.environ if into is None else into
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for k, v in parse(f.read()).items():
                at.setdefault(k, v)
    return at


def switch(name: str, given: Mapping[str, str]) -> bool:
    """Whether a switch is on: 1, true, yes or on in any case; off for anything else that is set; else its default."""
    value = given.get(name, "").strip().lower()
    return value in ("1", "true", "yes", "on") if value else SWITCHES[name]
