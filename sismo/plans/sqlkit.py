"""DuckDB oracle SQL building blocks.

Each oracle query is ``WITH <needed CTEs> <body>``; CTEs are declared once
here with their dependencies and pulled in transitively in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fixtures import CAT_RAW_SQL, CAT_SQL

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, deps: tuple[str, ...] = ()) -> None:
    _CTES[name] = (deps, text)


def build(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = _CTES[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [_CTES[n][1] for n in order]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body


# Snap offset of the comparison grid: 1/pi instead of 1/2, so values with a
# short decimal expansion (means of few 4-decimal values: 2.5236875) never
# sit on a grid boundary where last-bit differences of summation order would
# send the two engines to different sides.
SNAP = 0.3183098861837907


def R6(x: str) -> str:
    """SQL twin of :func:`r6`."""
    return f"(floor(({x}) * 1000000.0 + {SNAP!r}) / 1000000.0)"


def r6(c: Column | str) -> Column:
    """Snap to a 1e-6 grid by the same IEEE arithmetic in both engines (sum
    order makes the last bits of averages engine-dependent). A comparison
    device for registered queries; operators return full precision."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.floor(col * F.lit(1000000.0) + F.lit(SNAP)).cast("double") / F.lit(1000000.0))


# The catalogue (two inner CTEs) and its text twins (two inner CTEs).
cte("cat", CAT_SQL.strip())
cte("cat_raw", CAT_RAW_SQL.strip(), ("cat",))
