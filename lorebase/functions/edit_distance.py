"""Edit distance with adjacent transpositions (optimal string alignment), of whole terms and of prefixes."""

from __future__ import annotations


def distance(a: str, b: str, prefix: bool = False) -> int:
    """Edits from a to b; with prefix, to the nearest prefix of b."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return min(row) if prefix else row[-1]
