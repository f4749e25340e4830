"""Sequence similarity for the places where a ratio matters and Spark has no function: plain Python, used in batches."""

from __future__ import annotations

import unicodedata


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def near(value: str, quote: str, least: float = 0.86) -> bool:
    """Whether some window of the quote, as long as the value, is as near as `least`; windows begin at words."""
    value, quote = value.strip().lower(), quote.lower()
    if not value:
        return False
    starts = [0] + [i + 1 for i, c in enumerate(quote) if c == " "]
    return any(indel_ratio(value, quote[s : s + len(value)]) >= least for s in starts)


def hungarian(cost: list[list[float]]) -> list[tuple[int, int]]:
    """The one-to-one assignment of least cost, rows to columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return []
    if n > m:
        return sorted((j, i) for i, j in hungarian([list(r) for r in zip(*cost, strict=True)]))
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sorted((p[j] - 1, j - 1) for j in range(1, m + 1) if p[j])


def edit_matches(a: str, b: str) -> list[tuple[int, int]]:
    """Places of the equal characters of one least-cost alignment (insertion, deletion, substitution cost 1), in order.

    For each cost the farthest place on each diagonal is kept, so an alignment of cost d takes memory for d * d places
    and not for the texts' lengths multiplied.
    """
    n, m = len(a), len(b)
    fronts: list[dict[int, tuple[int, int]]] = []
    cost = 0
    while True:
        before, now = (fronts[-1] if fronts else {}), {}
        for k in range(-min(cost, m), min(cost, n) + 1):
            i = 0 if cost == 0 else max(_steps(before, k, n, m), default=-1)
            if i < 0:
                continue
            end = i
            while end < n and end - k < m and a[end] == b[end - k]:
                end += 1
            now[k] = (i, end)
        fronts.append(now)
        if now.get(n - m, (0, -1))[1] == n:
            break
        cost += 1
    out, k = [], n - m
    for cost in range(len(fronts) - 1, -1, -1):
        start, end = fronts[cost][k]
        out += [(i, i - k) for i in range(end - 1, start - 1, -1)]
        if cost:
            before = fronts[cost - 1]
            # The diagonal it came from: a deletion comes from the one below, an insertion from the one above.
            k = next(q for q, moved in ((k, 1), (k - 1, 1), (k + 1, 0)) if q in before and before[q][1] + moved == start and start in _steps({q: before[q]}, k, n, m))
    return out[::-1]


def _steps(before: dict[int, tuple[int, int]], k: int, n: int, m: int) -> list[int]:
    """Places on diagonal k that one edit reaches from the farthest places of the cost before."""
    out = []
    for q, moved in ((k, 1), (k - 1, 1), (k + 1, 0)):
        if q in before:
            i = before[q][1] + moved
            if i <= n and 0 <= i - k <= m:
                out.append(i)
    return out


def base_letters(text: str) -> list[tuple[str, str]]:
    """(letter without marks, the character it stands in) of a composed text; đ is a d with a mark."""
    out = []
    for c in unicodedata.normalize("NFC", text):
        plain = {"đ": "d", "Đ": "D"}.get(c) or unicodedata.normalize("NFD", c)
        out += [(x, c) for x in plain if not unicodedata.combining(x)]
    return out


def mark_errors(reference: str, hypothesis: str) -> tuple[int, int]:
    """(letters whose marks differ, letters aligned): texts are aligned without marks, and equal letters compared with them."""
    r, h = base_letters(reference), base_letters(hypothesis)
    pairs = [(r[i], h[j]) for i, j in edit_matches("".join(x for x, _ in r), "".join(x for x, _ in h))]
    letters = [(x, y) for x, y in pairs if x[0].isalpha()]
    return sum(x[1] != y[1] for x, y in letters), len(letters)
