"""The walk of ``anchors`` over a long query, many lanes of it at once.

Where a walk goes from a place depends on the last anchor only as long as its diagonal is near; after that, walks that stand
at one place are one. So a query is cut into lanes, each is walked from a little before its begin, and all take their steps
together: only words of places that some walk visits are looked up, and no word of the query is sorted. A lane that the one
before enters in another state than it began with is walked again from there, until all agree.
"""

from __future__ import annotations

import numpy as np

from .anchors import OVERLAP, WORD, Query, State, Subject, _cells, _common, _equal_cells, _words_at, common_prefix

#: Letters of a lane, and before it where its walk begins; letters of lanes that are walked at once; places of a word that are
#: compared one by one; times that lanes are walked again together before they are one after the other.
LANE, LEAD, SEGMENT, FEW, ROUNDS = 1024, 256, 1 << 23, 64, 16
_FAR = -(1 << 60)


def _advance(subject: Subject, query: Query, pos: np.ndarray, diagonal: np.ndarray, end_q: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks from these places (with the last anchor's diagonal and end) up to limits; the arrays then tell where they stand.

    Returns which ones stopped at a match that goes far beyond the limit, or to where letters are known, and the anchors:
    (lane, place in query, place in subject, length) in columns.
    """
    least, index, begin, known = subject.threshold, subject.index, query.begin, query.known
    opened, found = np.zeros(len(pos), bool), []
    live = np.flatnonzero(pos < limits)
    while len(live):
        p = pos[live]
        most = np.minimum(limits[live] + OVERLAP, known) - p
        length, at, far = np.zeros(len(live), np.int64), np.full(len(live), -1, np.int64), np.zeros(len(live), bool)
        ahead = p + diagonal[live]
        k = np.flatnonzero((p - end_q[live] <= least) & (ahead <= len(subject.letters) - least) & (p + least <= query.total))
        if len(k):
            n = _common(query, p[k] - begin, subject, ahead[k], most[k])
            k, n = k[n >= least], n[n >= least]
            length[k], at[k], far[k] = n, ahead[k], n >= most[k]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            words = _words_at(query.letters, p[rest] - begin)
            order = np.argsort(words)
            rest, words = rest[order], words[order]
            n, place = index.probed(words, known - p[rest], least)
            length[rest], at[rest] = n, np.maximum(place, -1)
            k = rest[(place >= 0) & (n >= WORD)]
            if len(k):
                length[k] = WORD + _common(query, p[k] - begin + WORD, subject, at[k] + WORD, most[k] - WORD)
                far[k] = length[k] >= most[k]
            several = np.flatnonzero(place < -1)
            if len(several):
                k, first = rest[several], -2 - place[several]
                count = index.rank(words[several], "right") - first
                _several(subject, query, k, first, count, p, most, length, at, far)
        hit = np.flatnonzero((at >= 0) & (length >= least) & ~far)
        found.append(np.stack((live[hit], p[hit], at[hit], length[hit])))
        diagonal[live[hit]], end_q[live[hit]] = at[hit] - p[hit], p[hit] + length[hit]
        on = ~far
        pos[live[on]] = p[on] + length[on] + 1
        opened[live[far]] = True
        live = live[on]
        live = live[pos[live] < limits[live]]
    return opened, np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)


def _several(subject: Subject, query: Query, k: np.ndarray, first: np.ndarray, count: np.ndarray, p: np.ndarray, most: np.ndarray, length: np.ndarray, at: np.ndarray, far: np.ndarray) -> None:
    """The longest matches of places ``k`` whose words stand at several places, by rank ``first``, and where, if at one alone."""
    index, few = subject.index, count <= FEW
    counts = count[few]
    places = [index.places[np.arange(int(counts.sum())) + np.repeat(first[few] - np.cumsum(counts) + counts, counts)].astype(np.int64)]
    keys, counts, depths = k[few].tolist(), counts.tolist(), [WORD] * len(counts)
    for x, rank, n in zip(k[~few].tolist(), first[~few].tolist(), count[~few].tolist()):
        place = int(p[x]) - query.begin
        got = index.deeper(rank, rank + n, lambda depth: int(_words_at(query.letters, np.array([place + depth]))[0]), int(most[x]), FEW)
        if got is None or got[0] >= most[x]:
            far[x] = True
        elif got[2]:
            length[x], at[x] = got[0], int(got[1][0]) if len(got[1]) == 1 else -1
        else:
            keys.append(x)
            counts.append(len(got[1]))
            depths.append(got[0])
            places.append(got[1].astype(np.int64))
    if keys:
        keys, counts, depths, places = np.array(keys), np.array(counts), np.array(depths), np.concatenate(places)
        starts = np.cumsum(counts) - counts
        depth = np.repeat(depths, counts)
        n = _common(query, np.repeat(p[keys] - query.begin, counts) + depth, subject, places + depth, np.repeat(most[keys], counts) - depth)
        longest = np.maximum.reduceat(n, starts)
        best = n == np.repeat(longest, counts)
        length[keys] = depths + longest
        at[keys] = np.where(np.add.reduceat(best, starts, dtype=np.int64) == 1, np.add.reduceat(np.where(best, places, 0), starts), -1)
        far[keys] = length[keys] >= most[keys]


def walk_lanes(subject: Subject, query: Query, fourths: bool, state: State = State(), trace: list | None = None) -> tuple[np.ndarray, State]:
    """``walk_block``, by lanes."""
    least, begin, end, known, total = subject.threshold, query.begin, query.end, query.known, query.total
    told: dict[tuple, tuple] = {}
    at = [state.pos, state.last_s - state.last_q, state.last_q + state.last_n]  # where the walk stands: its place, the last anchor's diagonal and end
    anchors, waiting = [np.zeros((3, 0), np.int64)], None

    def single() -> tuple[int, list[int], bool]:
        """The match of the next place, and whether it stands on the last anchor's diagonal."""
        p, ahead = at[0], at[0] + at[1]
        if p - at[2] <= least and ahead <= len(subject.bytes) - least and p + least <= total:
            n = common_prefix(query.bytes, p - begin, subject.bytes, ahead)
            if n >= least:
                return n, [ahead], True
        n, place = (int(x[0]) for x in subject.index.probed(_words_at(query.letters, np.array([p - begin])), np.array([known - p]), least))
        if n >= WORD and place < -1:
            end = subject.index.equal(-2 - place)
            got = subject.index.deeper(-2 - place, end, lambda depth: int(_words_at(query.letters, np.array([p - begin + depth]))[0]), known - p, FEW) if end + 2 + place > FEW else None
            if got is None:
                return *subject.extended(query, p, -2 - place), False
            return (got[0], got[1].tolist(), False) if got[2] else (*subject.longest(query, p - begin, got[0], got[1].tolist()), False)
        if n >= WORD and place >= 0:
            n += common_prefix(query.bytes, p - begin + WORD, subject.bytes, place + WORD)
        return n, [place] if place >= 0 else [], False

    def take(n: int, places: list[int], lucky: bool) -> None:
        nonlocal waiting
        p = at[0]
        if p + n == known < total and places and (lucky or n >= WORD):
            waiting = (n, places, lucky)
            return
        if places and n >= least and (lucky or len(places) == 1):
            anchors.append(np.array([[p], [places[0]], [n]], np.int64))
            at[1:] = [places[0] - p, p + n]
        at[0] = p + n + 1

    if state.places:
        take(*subject.longest(query, at[0] - begin, state.depth, list(state.places)), state.lucky)
    for low in range(begin, end, SEGMENT):
        high = min(low + SEGMENT, end)
        if waiting is not None or at[0] >= high:
            continue
        starts = np.arange(low, high, LANE)
        limits = np.minimum(starts + LANE, high)
        first, entered, before = (at[0] - low) // LANE, list(at), len(anchors)
        pos, diagonal, end_q = np.maximum(starts - LEAD, begin), np.zeros(len(starts), np.int64), np.full(len(starts), _FAR)
        pos[: first + 1] = limits[: first + 1]
        opened, _ = _advance(subject, query, pos, diagonal, end_q, starts)
        pos[opened], end_q[opened] = starts[opened], _FAR
        pos[first], diagonal[first], end_q[first] = at
        began = [_standing(x, least) for x in zip(pos.tolist(), diagonal.tolist(), end_q.tolist())]
        opened, found = _advance(subject, query, pos, diagonal, end_q, limits)
        every, last, rounds = [found], np.zeros(len(starts), np.int64), 0

        def walked_again(which: list[tuple[int, int, int, int]]) -> None:
            """Lanes (number, and where a walk stands) from where the ones before ended."""
            redo, *where = (np.array(x, np.int64) for x in zip(*which))
            for n, *x in which:
                began[n] = _standing(x, least)
            opened[redo], found = _advance(subject, query, *where, limits[redo])
            pos[redo], diagonal[redo], end_q[redo] = where
            found[0], last[redo] = redo[found[0]], len(every)
            every.append(found)

        while True:
            at[:], waiting, k, used, again = entered, None, first, [], []
            del anchors[before:]
            while k < len(starts) and waiting is None:
                if _standing(at, least) != began[k]:
                    again.append((k, *at))
                    if rounds == ROUNDS:  # one lane after the other
                        walked_again([again.pop()])
                used.append(k)
                at[:] = int(pos[k]), int(diagonal[k]), int(end_q[k])
                while at[0] < limits[k] and waiting is None:
                    here = _standing(at, least)
                    if here not in told:
                        told[here] = single()
                    take(*told[here])
                k = (at[0] - low) // LANE if at[0] < high else len(starts)
            if not again:
                break
            walked_again(again)
            rounds += 1
        keep = np.zeros(len(starts), bool)
        keep[used] = True
        anchors += [x[1:, keep[x[0]] & (last[x[0]] == k)] for k, x in enumerate(every)]
    return _counted(subject, query, fourths, state, np.concatenate(anchors, axis=1), at[0], waiting, trace)


def _standing(at: tuple[int, int, int] | list[int], least: int) -> tuple[int, int, int]:
    """Where a walk stands: without a diagonal that is too far to matter."""
    p, diagonal, end_q = at
    return (p, diagonal, end_q) if p - end_q <= least else (p, 0, _FAR)


def _counted(subject: Subject, query: Query, fourths: bool, state: State, anchors: np.ndarray, pos: int, waiting: tuple | None, trace: list | None) -> tuple[np.ndarray, State]:
    """The counts that anchors (place in query, place in subject, length) add to a walk, and where it stands after them."""
    least, begin, end, border = subject.threshold, query.begin, query.end, subject.border
    q, s, n = anchors[:, np.argsort(anchors[0], kind="stable")]
    last_q, last_s, last_n = (np.concatenate(([a], b)) for a, b in ((state.last_q, q), (state.last_s, s), (state.last_n, n)))
    end_q, end_s = last_q + last_n, last_s + last_n
    paired = (s > end_s[:-1]) & (q - end_q[:-1] == s - end_s[:-1]) & ((s < border) == (last_s[:-1] < border))
    right = np.concatenate(([state.right], paired))
    counts = np.concatenate((paired, [False])) | right | (last_n >= 2 * least)
    equal = np.stack((last_s, last_n), axis=1)
    if end < query.total:
        counts[-1] = False
    elif last_n[-1] >= query.total:
        counts[-1], equal[-1, 1] = True, query.total
    if trace is not None:
        trace += zip(q.tolist(), s.tolist(), n.tolist(), paired.tolist())

    def gaps(which: np.ndarray, to: np.ndarray) -> np.ndarray:
        """What lies between anchors and places, as far as it is in this block, on the anchors' diagonals."""
        low = np.maximum(end_q[which], begin)
        at = last_s[which] + low - last_q[which]
        return np.stack((at, low, np.maximum(np.minimum(to - low, len(subject.bytes) - at), 0)), axis=1)

    before = np.array(state.between, np.int64)
    total = _equal_cells(subject, equal[counts], fourths) + _cells(subject, query, gaps(np.flatnonzero(paired), q[paired]))
    if len(q):
        total, before = total + before * bool(paired[0]), np.zeros(16, np.int64)
    if end < query.total:
        before = before + _cells(subject, query, gaps(np.array([len(q)]), np.array([min(pos, end) if waiting is not None else end])))
    depth, places, lucky = waiting or (0, [], False)
    last = (int(last_s[-1]), int(last_q[-1]), int(last_n[-1]), bool(right[-1]))
    return total, State(*last, pos, tuple(before.tolist()), depth, tuple(places), lucky)
