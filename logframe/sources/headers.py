"""Column keys from header labels."""

from __future__ import annotations

import re
from collections.abc import Sequence


def column_keys(headers: Sequence[str | None]) -> list[tuple[str, str]]:
    """(name, key) per header: the trimmed label, and a unique lower-case slug of it.

    Blank labels become ``column_N``; a repeated slug gets ``_2``, ``_3`` … until it is free.
    """
    out: list[tuple[str, str]] = []
    taken: set[str] = set()
    for position, raw in enumerate(headers, 1):
        name = (raw or "").removeprefix("\ufeff").strip() or f"column_{position}"
        slug = re.sub("[^a-z0-9]+", "_", name.lower()).strip("_") or f"column_{position}"
        key, n = slug, 1
        while key in taken:
            n += 1
            key = f"{slug}_{n}"
        taken.add(key)
        out.append((name, key))
    return out
