"""Headers of tables that people keep: their names, and the row that they stand in."""

from __future__ import annotations

import math

HEADER_ROWS = 10
_EDGES = "　 ﻿"


def norm_header(value) -> str:
    return "" if value is None or (isinstance(value, float) and math.isnan(value)) else str(value).strip().strip(_EDGES)


def find_header(rows: list[list], expected: list[str]) -> tuple[int, int]:
    """(row, hits) of the row among the first ten that has most of the expected names; the first of equals."""
    hits = [len({norm_header(v) for v in r} & set(expected)) for r in rows[:HEADER_ROWS]] or [0]
    best = max(range(len(hits)), key=lambda k: (hits[k], -k))
    return best, hits[best]
