"""Which columns a table's files should be sorted by, from the queries that have run.

Spark has no indexes; what makes a look-up cheap is that a file's rows are sorted, so that the minima and maxima in
Parquet's footers rule most row groups out. A column counts for each query that compares it with a literal or joins on
it, an equality for more than a range. Columns of unique keys come first, as inserts look them up.
"""

from __future__ import annotations

from collections import Counter

from lattis.plans.dialect import Col, Cond

THRESHOLD = 8


class Advisor:
    def __init__(self) -> None:
        self.seen: dict[str, Counter] = {}

    def note(self, table: str, where: list[Cond]) -> None:
        counts = self.seen.setdefault(table, Counter())
        for c in where:
            weight = 2 if c.op == "=" else 1
            counts[c.left.name] += weight
            if isinstance(c.right, Col):
                counts[c.right.name] += weight

    def sort_columns(self, table: str, indexes: tuple[tuple[str, ...], ...], most: int = 3) -> list[str]:
        """Columns by which to sort a table's files; none while too little is known."""
        keys = list(indexes[0]) if indexes else []
        often = [c for c, n in self.seen.get(table, Counter()).most_common() if n >= THRESHOLD]
        return list(dict.fromkeys(keys + often))[:most]
