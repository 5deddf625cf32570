"""Bin completion by branch and bound on a histogram of sizes.

A pack is opened by the largest item left and completed by a filling of its room. Fillings are enumerated from large to small; those that are not maximal are left out, and so are
dominated ones (Martello and Toth): fillings in which an item left outside could take the place of one or more items of at most its size, as those fit where it stood. The search branches
over the fillings, fullest first, and drops a branch when the waste so far leaves fewer packs than the best plan only if the rest wasted nothing. The best plan is at first that of best fit
decreasing. Rounds of limited discrepancy (0, 1, 2, any number of branches other than the first) spread the steps over all levels instead of the last ones only.

Nothing here recurses. On up to SMALL items a filling is used once per step, and a search that ends within its steps has the least number of packs. On larger histograms a filling is used
as often as the counts allow, so the search is over plans of that form; a plan whose packs equal `least_packs` is proven all the same.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np

SMALL = 64
STEPS = 1_500_000
FILL_STEPS = 4_000

Pattern = dict[int, int]


def least_packs(histogram: dict[int, int], capacity: int) -> int:
    """The greater of tokens over capacity and Martello and Toth's L2, over all thresholds that occur."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return 0
    n = np.array([histogram[int(s)] for s in sizes], np.int64)
    items = np.concatenate([[0], np.cumsum(n)])
    mass = np.concatenate([[0], np.cumsum(n * sizes)])
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))  # sizes up to half the capacity
    low = np.arange(half + 1)
    bound = np.where(low < len(sizes), sizes[np.minimum(low, len(sizes) - 1)], capacity + 1)
    bound = np.minimum(bound, capacity // 2 + 1)
    big = np.searchsorted(sizes, capacity - bound, side="right")  # from here on nothing of at least `bound` fits beside
    big = np.maximum(big, half)
    free = (items[big] - items[half]) * capacity - (mass[big] - mass[half])
    small = mass[half] - mass[low]
    need = items[-1] - items[half] + np.maximum(0, -(-(small - free) // capacity))
    return int(max(need.max(), -(-mass[-1] // capacity)))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing, many equal packs at a time."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, times))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n > 0:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                pattern, times, room = {}, n, capacity
            else:
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            copies = min(n, room // s)
            used = min(times, n // copies)
            if used < times and pattern:
                put(room, pattern, times - used)
            put(room - copies * s, {**pattern, s: copies}, used)
            n -= copies * used
    return [x for room in rooms for x in groups[room]]


def fillings(sizes: list[int], counts: dict[int, int], room: int, steps: int, waste: int, first: bool = False) -> tuple[list[tuple[int, Pattern]], bool, int]:
    """Maximal fillings (sum, pattern) that leave at most `waste` of the room, whether they are all, and the steps taken. first: the fullest found is enough, and an exact one ends the search.

    sizes: ascending, each with counts > 0.
    """
    top = bisect_right(sizes, room) - 1
    if top < 0:
        return ([(0, {})] if room <= waste else []), True, 1
    below = None
    if top < 256:
        below = [0]
        for s in sizes[: top + 1]:
            below.append(below[-1] + s * counts[s])
        if below[-1] <= room:
            return ([(below[-1], {s: counts[s] for s in sizes[: top + 1]})] if room - below[-1] <= waste else []), True, 1
    out: list[tuple[int, Pattern]] = []
    frames: list[list[int]] = []  # index and copies, larger sizes first
    left, k, taken, fullest = room, top, 0, -1
    while True:
        while k >= 0:
            s = sizes[k]
            copies = min(counts[s], left // s)
            frames.append([k, copies])
            left -= copies * s
            taken += 1
            k = min(k, bisect_right(sizes, left)) - 1
        if left <= waste and not (first and room - left <= fullest):
            chosen = {sizes[i]: c for i, c in frames}
            if not any(counts[s] > chosen.get(s, 0) for s in sizes[: bisect_right(sizes, left)]):
                fullest = max(fullest, room - left)
                if first:
                    out.clear()
                out.append((room - left, chosen))
                if first and not left:
                    return out, True, taken
        if taken >= steps:
            return out, False, taken
        while frames:
            f = frames[-1]
            left += sizes[f[0]]
            f[1] -= 1
            if not f[1]:
                frames.pop()
            taken += 1
            k = min(f[0], bisect_right(sizes, left)) - 1
            if k >= 0 and (below is None or left - below[k + 1] <= waste):
                break
        else:
            return out, True, taken


def dominated(total: int, pattern: Pattern, sizes: list[int], counts: dict[int, int], room: int, most: int = 12) -> bool:
    """Whether an item outside could replace items of the filling that together are at most its size. Fillings of more than `most` items aren't tested, which is safe."""
    if sum(pattern.values()) > most:
        return False
    sums: dict[int, int] = {0: 0}  # sum of a subset, and the most items it may have
    for s, n in pattern.items():
        for _ in range(n):
            for t, m in list(sums.items()):
                sums[t + s] = max(sums.get(t + s, 0), m + 1)
    for t, items in sums.items():
        at = bisect_right(sizes, room - total + t) - 1
        while t and at >= 0 and sizes[at] >= t:
            x = sizes[at]
            if counts[x] > pattern.get(x, 0) and (x > t or items > 1):
                return True
            at -= 1
    return False


class _Search:
    def __init__(self, histogram: dict[int, int], capacity: int, steps: int):
        self.capacity, self.steps, self.spent = capacity, steps, 0
        self.counts = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.counts)
        self.items, self.mass = sum(self.counts.values()), sum(s * n for s, n in self.counts.items())
        self.fill_steps = max(64, min(FILL_STEPS, 8_000_000 // max(1, len(self.sizes))))
        self.best = best_fit(self.counts, capacity)
        self.packs = sum(t for _, t in self.best)
        self.least = least_packs(self.counts, capacity)

    def _use(self, pattern: Pattern, times: int) -> None:
        for s, k in pattern.items():
            self.counts[s] -= k * times
            self.items -= k * times
            self.mass -= s * k * times
            if not self.counts[s]:
                self.sizes.pop(bisect_left(self.sizes, s))

    def _undo(self, pattern: Pattern, times: int) -> None:
        for s, k in pattern.items():
            if not self.counts[s]:
                insort(self.sizes, s)
            self.counts[s] += k * times
            self.items += k * times
            self.mass += s * k * times

    def _options(self, packs: int, first: bool) -> list[Pattern]:
        """Fillings around the largest item left, fullest first. The waste that a better plan may still have bounds them."""
        largest = self.sizes[-1]
        self.counts[largest] -= 1
        rest = self.sizes if self.counts[largest] else self.sizes[:-1]
        room = self.capacity - largest
        slack = (self.packs - 1 - packs) * self.capacity - self.mass
        found, whole, taken = fillings(rest, self.counts, room, self.fill_steps, min(room, slack), first)
        self.spent += taken
        if not first:
            self.whole &= whole
            if whole:
                found = [x for x in found if not dominated(*x, rest, self.counts, room)]
        self.counts[largest] += 1
        found.sort(key=lambda x: -x[0])
        return [{**p, largest: p.get(largest, 0) + 1} for _, p in found]

    def run(self, limit: int | None) -> bool:
        """One round; whether it looked at everything."""
        self.whole = True
        packs = other = 0
        used: list[tuple[Pattern, int]] = []
        seen: dict[tuple, int] = {}
        stack: list[list] = [[self._options(0, True), 0, False]] if self.sizes else []
        while stack:
            if self.packs <= self.least or (limit != 0 and self.spent > self.steps):
                self.whole = False
                break
            node = stack[-1]
            options, at, expanded = node
            if at == 1 and not expanded:
                if limit is not None and other >= limit:
                    self.whole = False
                    options = []
                else:
                    tried = options[0]
                    options = [tried, *[p for p in self._options(packs, False) if p != tried]]
                node[0], node[2] = options, True
            if at >= len(options):
                stack.pop()
                if used:
                    pattern, times = used.pop()
                    self._undo(pattern, times)
                    packs -= times
                    other -= stack[-1][1] > 1
                continue
            pattern = options[at]
            node[1] += 1
            times = 1 if self.items <= SMALL else min(self.counts[s] // k for s, k in pattern.items())
            if times > 1 or self.items > SMALL:
                self.whole = False
            self._use(pattern, times)
            packs += times
            done = not self.sizes
            if done and packs < self.packs:
                self.best, self.packs = [*used, (pattern, times)], packs
            state = tuple((s, self.counts[s]) for s in self.sizes) if limit is None and self.items <= SMALL else None
            if done or packs + -(-self.mass // self.capacity) >= self.packs or (state is not None and seen.get(state, packs + 1) <= packs):
                self._undo(pattern, times)
                packs -= times
                continue
            if state is not None and len(seen) < 200_000:
                seen[state] = packs
            used.append((pattern, times))
            other += at > 0
            options = self._options(packs, True)
            stack.append([options, 0, False] if options else [[], 0, True])
        while used:
            self._undo(*used.pop())
        return self.whole


def complete_bins(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[list[tuple[Pattern, int]], bool]:
    """Fillings and how often each is used: every item of the histogram (sizes 1..capacity) once; and whether no plan can have fewer packs."""
    search = _Search(histogram, capacity, steps)
    for limit in (0, 1, 2, None):
        if search.packs <= search.least:
            return search.best, True
        if search.run(limit):
            return search.best, True
        if search.spent > steps:
            break
    return search.best, search.packs <= search.least
