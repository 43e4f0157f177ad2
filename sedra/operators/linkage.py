"""Similarities of a document's distinct sentences a row at a time, from inverted indexes, and all sentences' average-linkage clusters.

Both take memory that is linear in the sentences, however many of them are alike.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

ROWS_KEPT = 1 << 25  # bytes of rows that are kept for use again
BLOCK = 1 << 20  # pairs of two clusters that are laid out at a time
MOST_PAIRS = 4096  # up to so many pairs, the sum of equal similarities is known as loops add it
KEPT = 1 << 18  # averages of kinds of clusters that are kept for use again
SUMS_KEPT = 256  # clusters of over a 256th of the sentences keep their sums, so there are at most so many


class Sets:
    """n sentences' sets of several kinds: `found` has a pair of arrays for each kind, sentences and numbers of members; members may be found again."""

    def __init__(self, found: Sequence[tuple[np.ndarray, np.ndarray]], n: int) -> None:
        self.n, self.kinds = n, len(found)
        self.begins = np.cumsum([0, *(int(m.max(initial=-1)) + 1 for _, m in found)])  # of a kind's members, when all are numbered through
        total = max(1, int(self.begins[-1]))
        pairs = np.concatenate([owners * total + (members + begin) for (owners, members), begin in zip(found, self.begins, strict=False)])
        pairs.sort()
        new = np.ones(len(pairs), bool)
        np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
        pairs = pairs[new]
        self.owners = pairs // total
        self.members = pairs - self.owners * total
        self.kind = np.searchsorted(self.begins[1:-1], self.members, "right")
        self.sizes = np.bincount(self.kind * n + self.owners, minlength=self.kinds * n).reshape(self.kinds, n).astype(np.float64)

    def overlaps(self) -> np.ndarray:
        """By kind, the Jaccard similarity of all pairs, 0 for two empty sets: members that several have are counted by matrix products."""
        n = self.n
        place = np.zeros(int(self.begins[-1]) + 1, np.int64)
        np.cumsum(np.bincount(self.members, minlength=len(place) - 1) > 1, out=place[1:])
        begins = place[self.begins].tolist()
        shared = place[self.members] < place[self.members + 1]
        row, col = self.owners[shared], place[self.members[shared]]
        both = np.zeros((self.kinds, n, n))
        for kind, (begin, end) in enumerate(zip(begins, begins[1:], strict=False)):
            for low in range(begin, end, 4096):
                high = min(low + 4096, end)
                now = slice(None) if high - low == begins[-1] else (col >= low) & (col < high)
                member = np.zeros((n, high - low), np.float32)
                member[row[now], col[now] - low] = 1
                both[kind] += member @ member.T
        both[:, np.arange(n), np.arange(n)] = self.sizes
        either = self.sizes[:, :, None] + self.sizes[:, None, :]
        either -= both
        either[either == 0] = 1
        both /= either
        return both


class Overlaps:
    """By kind, the Jaccard similarity of one set with all sets, 0 for two empty ones, by counting the postings of its members."""

    def __init__(self, sets: Sets) -> None:
        self.sets = sets
        self.of_set = np.concatenate(([0], np.bincount(sets.owners, minlength=sets.n).cumsum()))
        self.postings = (sets.kind * sets.n + sets.owners)[sets.members.argsort(kind="stable")]
        self.of_member = np.concatenate(([0], np.bincount(sets.members, minlength=int(sets.begins[-1])).cumsum()))

    def row(self, i: int) -> np.ndarray:
        sizes = self.sets.sizes
        own = self.sets.members[self.of_set[i] : self.of_set[i + 1]]
        if not len(own):
            return np.zeros(sizes.shape)
        met = np.concatenate([self.postings[a:b] for a, b in zip(self.of_member[own], self.of_member[own + 1], strict=True)])
        both = np.bincount(met, minlength=sizes.size).reshape(sizes.shape).astype(np.float64)
        either = sizes[:, i, None] + sizes - both
        either[either == 0] = 1
        return both / either


def rows_of(weights: Sequence[float], sets: Sets, lengths: Sequence[int], alike: float) -> Callable[[int], np.ndarray]:
    """row(i): sentence i's similarity with all. `weights` are those of the kinds of sets, `alike` is that of like lengths."""
    length, index = np.array(lengths, np.float64), Overlaps(sets)

    @lru_cache(maxsize=max(16, ROWS_KEPT // (8 * max(1, len(length)))))
    def row(i: int) -> np.ndarray:
        longest = np.maximum(length[i], length)
        apart = np.divide(np.abs(length[i] - length), longest, out=np.zeros_like(longest), where=longest > 0)
        return sum(weight * own for weight, own in zip(weights, index.row(i), strict=True)) + alike * (1 - apart)

    return row


def matrix_of(weights: Sequence[float], sets: Sets, lengths: Sequence[int], alike: float) -> np.ndarray:
    """All rows of rows_of() at once."""
    length = np.array(lengths, np.float64)
    longest = np.maximum(length[:, None], length)
    apart = np.abs(length[:, None] - length)
    longest[longest == 0] = 1
    apart /= longest
    return sum(weight * own for weight, own in zip(weights, sets.overlaps(), strict=True)) + alike * (1 - apart)


@lru_cache(maxsize=256)
def _averages_of_equals(value: float, most: int) -> np.ndarray:
    """By number of pairs, the average that loops find if all pairs have this similarity: none can be above it if no pair is."""
    table = np.full(most + 2, np.inf)
    table[1:-1] = np.full(most, value).cumsum() / np.arange(1, most + 1)
    return table


class Linkage:
    """Average-linkage clusters of sentences, in merge order: a merged cluster goes to the end.

    The most similar pair, the first of equals, is merged while its average is above `floor` and there are more than a
    third as many clusters as sentences, and more than two. Clusters are numbered as they arise, so numbers are in list
    order. `of` is what each sentence says: 0, 1, ... in order of first occurrence. row(a) is the similarity of a sentence
    that says a with others that say 0, 1, ..., a included: equal sentences share a row.

    Clusters whose members say the same in the same order are of one kind, and have the same averages with all others. So
    work and memory go by kinds; of a kind's clusters, the first has all later partners that the others have, and comes
    before them. Of every kind only a bound on its first cluster's averages with later ones is held. The highest bound is
    looked at first: it is merged if a pair reaches it, else worked out again from rows. Averages come from sums over rows,
    with a bound on their rounding; where that leaves a choice they are summed one by one over the members in order, as
    plain loops do, so that equal averages stay equal.
    """

    def __init__(self, row: Callable[[int], np.ndarray], of: np.ndarray, floor: float) -> None:
        self.row, self.n, self.floor = row, len(of), floor
        said = int(of.max(initial=-1)) + 1
        # By kind, from 1. There are never more kinds than clusters; numbers of kinds that are gone are taken again.
        self.kinds, self.free = said + 1, []
        self.kind = np.zeros(2 * self.n + 1, np.int64)  # of a cluster; 0 for those that are gone
        self.kind[: self.n] = of + 1
        self.first, self.last = np.full(self.n + 1, 2 * self.n), np.full(self.n + 1, -1)
        self.first[self.kind[: self.n][::-1]] = np.arange(self.n)[::-1]
        self.last[self.kind[: self.n]] = np.arange(self.n)
        self.first[0], self.last[0] = 2 * self.n, -1
        self.size = np.ones(self.n + 1)
        self.top = np.zeros(self.n + 1)  # the highest similarity of a member with another sentence
        self.bound = np.full(self.n + 1, floor)
        self.partner = np.full(self.n + 1, -1)

    def run(self) -> list[list[int]]:
        until = max(2, self.n // 3)
        if self.n <= until:
            return [[i] for i in range(self.n)]
        self._bound()
        if self.bound.max() <= self.floor:
            return [[i] for i in range(self.n)]
        self._begin()
        while len(self.members) > until:
            bound = self.bound[: self.kinds]
            kind = int(bound.argmax())
            best = bound[kind]
            if best <= self.floor:
                break
            highest = (bound == best).nonzero()[0].tolist()
            c, kind = min([(self.numbers[k][0], k) for k in highest]) if len(highest) > 1 else (self.numbers[kind][0], kind)
            d = int(self.partner[kind])
            if d > c and self.kind[d]:
                self._merge(c, d)
            elif not self._next_tied(kind, c):
                self._look(kind)
        return list(self.members.values())

    def _bound(self) -> None:
        """Bounds of single sentences. A partner is noted where all that reach the bound begin later."""
        said = self.kinds - 1
        first, last = self.first[1 : self.kinds], self.last[1 : self.kinds]
        step = max(1, BLOCK // said)
        for low in range(0, said, step):
            own = np.arange(low, min(low + step, said))
            rows = np.array([self.row(a) for a in own.tolist()])
            rows[own - low, own] *= first[own] < last[own]
            self.top[own + 1] = rows.max(axis=1)
            before = 0
            if said < self.n:
                earlier = first <= first[own, None]
                before = np.where(earlier & (last > first[own, None]), rows, 0).max(axis=1)
                rows[earlier] = 0
            else:
                rows *= np.arange(said) > own[:, None]
            best = rows.argmax(axis=1)
            after = rows[own - low, best]
            self.bound[own + 1] = np.maximum(before, after)
            self.partner[own + 1] = np.where(before < after, first[best], -1)
        self.bound[self.bound < self.floor] = self.floor

    def _begin(self) -> None:
        said = self.kinds - 1
        self.members = {i: [i] for i in range(self.n)}
        self.numbers: list[list[int]] = [[] for _ in range(self.kinds)]
        for i, kind in enumerate(self.kind[: self.n].tolist()):
            self.numbers[kind].append(i)
        self.says = list(np.arange(-1, said)[:, None])
        self.known: dict[bytes, int] = {}  # kinds of several members
        self.ordered = np.ones(self.n + 1, bool)  # sums were, or would be, added member by member
        self.sums: dict[int, np.ndarray] = {}
        # What the members of all kinds say, kind by kind; places of kinds that are gone count for kind 0.
        self.place_says, self.place_kind = np.zeros(2 * self.n + 2, np.int64), np.zeros(2 * self.n + 2, np.int64)
        self.place_says[:said], self.place_kind[:said] = np.arange(said), np.arange(1, self.kinds)
        self.places, self.gone = said, 0
        self.start = np.arange(-1, self.n)
        self.new = self.n
        self.born = [0] * self.kinds  # which arrival a kind's number is from
        self.arrivals = 0
        self.tied: dict[int, list[tuple[int, int]]] = {}  # of single sentences' kinds, where known: all kinds that reach the bound
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # averages, until kinds come or go

    def _summed(self, says: np.ndarray) -> np.ndarray:
        total = self.row(int(says[0]))
        for a in says[1:].tolist():
            total = total + self.row(a)
        return total

    def _sums(self, kind: int) -> np.ndarray:
        return self.sums[kind] if kind in self.sums else self._summed(self.says[kind])

    def _averages(self, kind: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A kind's averages with all kinds, how far off the loops' averages they can be, and how high those can be.

        They are the same where one of two clusters is a single sentence and sums run in the loops' order: over the
        members of the other, or over this one's, if its sums were added one by one.
        """
        if kind in self.kept:
            return self.kept[kind]
        sums = self._sums(kind) if sums is None else sums
        size = self.size[: self.kinds]
        average = np.bincount(self.place_kind[: self.places], sums[self.place_says[: self.places]], self.kinds)
        average[0] = 0
        if self.size[kind] == 1:
            average /= size
            off, high = np.zeros(self.kinds), average
        else:
            average /= size * self.size[kind]
            off, high = np.zeros(self.kinds), average.copy()
            unsure = (size > 1).nonzero()[0] if self.ordered[kind] else slice(None)
            pairs = size[unsure] * self.size[kind]
            most = min(MOST_PAIRS, (1 << int(pairs.max(initial=1)).bit_length()) - 1)
            equal = _averages_of_equals(float(self.top[kind]), most)[np.minimum(pairs, most + 1).astype(np.int64)]
            off[unsure] = by = (pairs + 16) * 5e-16
            high[unsure] = np.minimum(average[unsure] + by, equal)
        if len(self.kept) * self.kinds < KEPT:
            self.kept[kind] = average, off, high
        return average, off, high

    def _first_after(self, kind: int, c: int) -> int:
        own = self.numbers[kind]
        return own[bisect_right(own, c)]

    def _next_tied(self, kind: int, c: int) -> bool:
        """Whether the bound is known to be reached by another later partner, which is then noted."""
        later = [self._first_after(k, c) for k, born in self.tied.get(kind, ()) if self.born[k] == born and self.last[k] > c]
        if later:
            self.partner[kind] = min(later)
        return bool(later)

    def _look(self, kind: int) -> None:
        """The best later partner of a kind's first cluster, the first of equals."""
        c = self.numbers[kind][0]
        average, off, high = self._averages(kind)
        later = self.last[: self.kinds] > c
        average, high = average * later, high * later
        best, at = self.floor, -1
        found = (high >= max((average - off).max(), np.nextafter(best, 1))).nonzero()[0].tolist()
        for d, other in sorted((self._first_after(k, c), k) for k in found):
            if high[other] > best:
                value = float(average[other]) if off[other] == 0 else self._exact(self.says[kind], self.says[other])
                if value > best:
                    best, at = value, d
        self.bound[kind], self.partner[kind] = (best, at) if at >= 0 else (self.floor, -1)
        if self.size[kind] == 1:
            self.tied[kind] = [(k, self.born[k]) for k in found]

    def _exact(self, first: np.ndarray, second: np.ndarray) -> float:
        if len(first) * len(second) <= BLOCK:
            if len(second) < len(first):
                every = np.array([self.row(b)[first] for b in second.tolist()]).T
            else:
                every = np.array([self.row(a)[second] for a in first.tolist()])
            return float(every.cumsum()[-1]) / every.size
        total = np.zeros(1)
        for a in first.tolist():
            total = np.concatenate((total[-1:], self.row(a)[second])).cumsum()
        return float(total[-1]) / (len(first) * len(second))

    def _merge(self, c: int, d: int) -> None:
        first, second = int(self.kind[c]), int(self.kind[d])
        says = np.concatenate((self.says[first], self.says[second]))
        kind = self.known.get(says.tobytes())
        ordered = bool(self.size[second] == 1 and self.ordered[first] or first not in self.sums and second not in self.sums)
        if kind is not None:
            sums = None
        elif first in self.sums and self.size[second] == 1 or not ordered:
            sums = self._sums(first) + self._sums(second)
        else:
            sums = self._summed(says)
        top = max(self.top[first], self.top[second])
        self._leave(c, first)
        self._leave(d, second)
        new = self.new
        self.new += 1
        self.members[new] = self.members.pop(c) + self.members.pop(d)
        if kind is None:
            kind = self._arrive(says)
            self.first[kind], self.ordered[kind], self.top[kind] = new, ordered, top
            if not ordered or len(says) * SUMS_KEPT > self.n:
                self.sums[kind] = sums
        self.kind[new] = kind
        self.numbers[kind].append(new)
        self.last[kind] = new
        _, off, high = self._averages(kind, sums)
        if self.first[kind] == new:
            high = high.copy()
            high[kind] = 0
        bound = self.bound[: self.kinds]
        reached = (high >= bound).nonzero()[0]
        for other, value, known in zip(reached.tolist(), high[reached].tolist(), (off[reached] == 0).tolist(), strict=True):
            if value > bound[other]:
                bound[other], self.partner[other] = value, new if known else -1
                self.tied.pop(other, None)
            elif not known:
                self.tied.pop(other, None)
            elif other in self.tied and (kind, self.born[kind]) not in self.tied[other]:
                self.tied[other].append((kind, self.born[kind]))

    def _leave(self, cluster: int, kind: int) -> None:
        """A cluster goes, and its kind with the last one."""
        self.kind[cluster] = 0
        own = self.numbers[kind]
        del own[bisect_right(own, cluster) - 1]
        if own:
            self.first[kind], self.last[kind] = own[0], own[-1]
            return
        says = self.says[kind]
        self.first[kind], self.last[kind], self.bound[kind], self.size[kind] = 2 * self.n, -1, self.floor, 1
        self.place_kind[self.start[kind] : self.start[kind] + len(says)] = 0
        self.gone += len(says)
        self.sums.pop(kind, None)
        self.tied.pop(kind, None)
        self.kept.clear()
        self.known.pop(says.tobytes(), None)
        self.free.append(kind)

    def _arrive(self, says: np.ndarray) -> int:
        """The number of a new kind, with its places."""
        if self.gone * 4 > self.places:
            kept = np.nonzero(self.place_kind[: self.places])[0]
            self.places, self.gone = len(kept), 0
            self.place_says[: len(kept)], self.place_kind[: len(kept)] = self.place_says[kept], self.place_kind[kept]
            begins = np.nonzero(np.diff(self.place_kind[: len(kept)], prepend=0))[0]
            self.start[self.place_kind[begins]] = begins
        if self.free:
            kind = self.free.pop()
            self.says[kind] = says
        else:
            kind = self.kinds
            self.kinds += 1
            self.says.append(says)
            self.numbers.append([])
            self.born.append(0)
        self.known[says.tobytes()] = kind
        self.kept.clear()
        self.arrivals += 1
        self.born[kind] = self.arrivals
        self.size[kind], self.bound[kind], self.partner[kind] = len(says), self.floor, -1
        self.start[kind] = self.places
        self.place_says[self.places : self.places + len(says)] = says
        self.place_kind[self.places : self.places + len(says)] = kind
        self.places += len(says)
        return kind
