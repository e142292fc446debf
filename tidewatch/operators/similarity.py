"""Set similarity of rows to a block of known sets, inside a task.

Members of sets are put in one order, rarest among the known sets first.  A row looks its members up in that order, so
the sets it meets first share something rare with it, and what stands in many or all sets comes last.  With s members of n
still to look up, a set not met so far shares at most s of them and is at most s / n similar; a set that was met can gain
at most s more.  Once the best similarity reaches the first bound, only sets that can still pass it are
verified, each once, by whole sets.
"""

from __future__ import annotations

import numpy as np

#: Entries of postings that a row reads before it asks whether it may stop.
STEP = 256


class Index:
    """Postings of a block of sets."""

    def __init__(self, sets: list[list]):
        sets = [set(x) for x in sets]
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        counts: dict = {}
        for x in sets:
            for m in x:
                counts[m] = counts.get(m, 0) + 1
        # rarest first; ties in any order, which decides about work only
        self.number = {m: i for i, m in enumerate(sorted(counts, key=counts.__getitem__))}
        members = [np.array(sorted(self.number[m] for m in x), dtype=np.int64) for x in sets]
        flat = np.concatenate([np.zeros(0, np.int64), *members])
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.posting = owner[order]
        self.at = np.searchsorted(flat[order], np.arange(len(counts) + 1))
        self.members = members

    def top(self, members, n: int, enough: float | None = None, least: float = 0.0) -> float:
        """The greatest similarity of a set of n members to any set of the block; 0 without a common member.

        enough: stop at any similarity from there on.  least: similarities below it may be reported as 0.
        """
        got = [self.number[m] for m in members if m in self.number]
        if not got or len(got) < least * n:
            return 0.0
        ids = np.sort(np.array(got, dtype=np.int64))
        reads = np.cumsum(self.at[ids + 1] - self.at[ids])
        best, done, budget = 0.0, 0, STEP
        shared = np.zeros(len(self.size), dtype=np.int64) if reads[-1] > STEP else None
        while True:
            upto = max(done + 1, int(np.searchsorted(reads, budget, side="right")))
            met = np.concatenate([self.posting[self.at[i] : self.at[i + 1]] for i in ids[done:upto]])
            if shared is None:
                some, both = np.unique(met, return_counts=True)
            else:
                np.add.at(shared, met, 1)
                some = np.flatnonzero(shared)
                both = shared[some]
            left = len(ids) - upto
            share = both / (n + self.size[some] - both)
            best = max(best, float(share.max()))
            if left == 0 or enough is not None and best >= enough:
                return best
            if left <= max(best, least) * n:
                # sets that were not met can't pass any more; those that were are verified if they may
                most = np.minimum(both + left, self.size[some])
                mine = set(ids.tolist())
                for i in some[most / (n + self.size[some] - most) > best].tolist():
                    common = sum(x in mine for x in self.members[i].tolist())
                    best = max(best, common / (n + int(self.size[i]) - common))
                return best
            done, budget = upto, budget * 4
