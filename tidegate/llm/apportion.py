"""Highest-averages apportionment (odd divisors) of whole seats, with upper bounds."""
from __future__ import annotations

import heapq


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats per party: each further seat goes to the highest weight / (2 * seats + 1), ties to the
    earlier party; a party at its cap takes none. Fewer seats are given if all caps are reached.

    Rounding weight / divisor is itself such an allocation for its own total, so only the few seats
    it misses or exceeds are then moved one by one.
    """
    n, total = len(weights), float(sum(weights))
    caps = caps or [seats] * n
    seats = min(seats, sum(c for c, w in zip(caps, weights) if w > 0))
    if total <= 0 or seats <= 0:
        return [0] * n
    out, free, left = [0] * n, [i for i in range(n) if weights[i] > 0], seats
    while True:                                             # parties that their cap stops, then the rest by rounding
        mass = sum(weights[i] for i in free)
        over = [i for i in free if mass and weights[i] * left / mass > caps[i]]
        if not over:
            break
        for i in over:
            out[i] = caps[i]
        left, free = seats - sum(out), [i for i in free if i not in set(over)]
    for i in free:
        out[i] = min(caps[i], int(weights[i] * left / mass + 0.5))
    missing = seats - sum(out)
    up = [(-weights[i] / (2 * out[i] + 1), i) for i in range(n) if weights[i] > 0 and out[i] < caps[i]]
    down = [(weights[i] / (2 * out[i] - 1), -i) for i in range(n) if out[i] > 0]
    heap = up if missing > 0 else down
    heapq.heapify(heap)
    for _ in range(abs(missing)):
        _, i = heapq.heappop(heap)
        i = abs(i)
        out[i] += 1 if missing > 0 else -1
        if missing > 0 and out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
        elif missing < 0 and out[i] > 0:
            heapq.heappush(heap, (weights[i] / (2 * out[i] - 1), -i))
    return out


def shares(sizes: list[float], weights: list[float], total: float, times: float = 2.0) -> list[float]:
    """``total`` by weight, none above ``times`` its size; what is cut off is shared again by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while free:
        mass = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / mass > times * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / mass
            break
        for i in over:
            out[i] = times * sizes[i]
            left -= out[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out
