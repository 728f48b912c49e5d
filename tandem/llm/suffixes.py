"""Suffix arrays of many short texts at once, by linear grouping.

Phase one visits the groups of suffixes from the highest to the lowest. For
each suffix of the group it finds the previous smaller one: the nearest
position before it in a lower group. The positions so pointed at leave their
group for new ones right above it, ordered by how many pointers they got. In
the end the groups are those of equal Lyndon prefix, in order, with no ranks
computed anew. Phase two walks the order from its start and hands each group's
next place to the position before, and on along the previous-smaller pointers.

The texts are independent, so each step is done for all of them together, as
array operations: one group of every text in phase one, one place in phase two.
"""

from __future__ import annotations

import numpy as np

from tandem.llm.common import ranges

LANES = 600_000  # characters that are sorted together


def _grouped(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group start of each position, previous smaller position or -1)."""
    key = np.repeat(np.arange(len(start)) * (int(chars.max()) + 1), size) + chars
    order = np.argsort(key, kind="stable").astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    del key
    group = np.empty(len(chars), np.int32)
    counts = np.diff(np.concatenate([first, [len(chars)]]))
    group[order] = np.repeat(first, counts)
    members = np.zeros(len(chars), np.int32)
    members[first] = counts
    place = np.empty(len(chars), np.int32)
    place[order] = np.arange(len(chars), dtype=np.int32)
    before = np.arange(-1, len(chars) - 1, dtype=np.int32)
    before[start] = -1
    moving = np.zeros(len(chars), bool)
    last = start + size - 1
    live = np.arange(len(start))
    while len(live):
        end = last[live]
        low = group[order[end]]
        count = end - low + 1
        at = order[ranges(low, count)]
        own = np.repeat(low, count)
        # Previous smaller: jump over positions of the same or a higher group.
        todo = np.arange(len(at))
        while len(todo):
            p = before[at[todo]]
            up = p >= 0
            up[up] = group[p[up]] >= own[todo[up]]
            todo = todo[up]
            before[at[todo]] = before[p[up]]
        last[live] = low - 1
        live = live[low > start[live]]
        p = before[at]
        p = np.sort(p[p >= 0])
        if not len(p):
            continue
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        hits = np.diff(np.concatenate([new, [len(p)]]))
        p = p[new]
        # Positions move to the end of their group, by the number of pointers.
        by = np.lexsort((hits, group[p]))
        p, hits = p[by], hits[by]
        home = group[p]
        head = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        moved = np.diff(np.concatenate([head, [len(p)]]))
        tail = home[head] + members[home[head]] - moved
        target = ranges(tail, moved)
        was = place[p]
        leaving = np.repeat(tail, moved)
        out = was < leaving  # places that fall free below the tail
        held = order[target]
        moving[p] = True
        stays = ~moving[held]
        moving[p] = False
        free = was[out]
        order[free] = held[stays]
        place[held[stays]] = free
        order[target] = p
        place[p] = target
        members[home[head]] -= moved
        cut = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (hits[1:] != hits[:-1])]))
        part = np.diff(np.concatenate([cut, [len(p)]]))
        members[target[cut]] = part
        group[p] = np.repeat(target[cut], part)
    return group, before


def suffix_arrays(texts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of concatenated texts, as positions in ``texts``, one text after another.

    Every text must end with a character smaller than all others in it.
    """
    start = np.cumsum(size) - size
    group, before = _grouped(texts, start, size)
    out = np.full(len(texts), -1, np.int32)
    done = np.zeros(len(texts), bool)
    slot = np.arange(len(texts), dtype=np.int32)
    end = start + size
    out[start] = end - 1
    done[end - 1] = True
    at, live_end, first = start.copy(), end, start
    j = np.where(size > 1, end - 2, -1)
    while len(at):
        go = j >= 0
        go[go] = ~done[j[go]]
        put = j[go]
        g = group[put]
        out[slot[g]] = put
        slot[g] += 1
        done[put] = True
        j[go] = before[put]
        rest = np.flatnonzero(~go)
        if len(rest):
            at[rest] += 1
            over = at[rest] >= live_end[rest]
            nxt = rest[~over]
            s = out[at[nxt]]
            j[nxt] = np.where(s > first[nxt], s - 1, -1)
            if over.any():
                keep = np.ones(len(at), bool)
                keep[rest[over]] = False
                at, j, live_end, first = at[keep], j[keep], live_end[keep], first[keep]
    return out


def repeated(segments: list[bytes], lane: np.ndarray, window: int, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment a mask of the starts whose ``window`` bytes occur at another start of its lane.

    Only starts with a whole window inside their segment count. Segments of one
    lane must be neighbours in the list. Of ``known`` segments the answer is
    not needed: a lane of nothing else is not sorted.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    found = [np.zeros(max(0, n - window + 1), bool) for n in sizes]
    if not len(segments):
        return found
    first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    many = np.diff(np.concatenate([first, [len(lane)]]))
    total = np.add.reduceat(sizes + 1, first)
    picked = np.argsort(total, kind="stable")
    picked = picked[many[picked] > 1]
    if known is not None:
        picked = picked[~np.logical_and.reduceat(known, first)[picked]]
    cut = np.searchsorted(np.cumsum(total[picked]), np.arange(LANES, total[picked].sum() + LANES, LANES), "right")
    for a, b in zip(np.concatenate([[0], cut[:-1]]), cut):
        own = picked[a : max(b, a + 1)] if b > a else picked[a:b]
        if not len(own):
            continue
        which = ranges(first[own], many[own])
        n = sizes[which]
        # Bytes from 2 on; 1 ends a segment, 0 a lane.
        text = np.ones(int((n + 1).sum()), np.int16)
        begin = np.cumsum(n + 1) - (n + 1)
        text[ranges(begin, n)] = np.frombuffer(b"".join(segments[i] for i in which), np.uint8).astype(np.int16) + 2
        text[np.cumsum(total[own]) - 1] = 0
        order = suffix_arrays(text, total[own])
        valid = np.zeros(len(text), bool)
        valid[ranges(begin, np.maximum(0, n - window + 1))] = True
        x, y = order[:-1], order[1:]
        both = np.flatnonzero(valid[x] & valid[y])
        packed = np.zeros(len(text) + window, np.uint64)
        padded = np.concatenate([text, np.zeros(window + 8, np.int16)]).astype(np.uint64)
        for k in range(7):
            packed |= padded[k : k + len(packed)] << np.uint64(9 * k)
        for k in [*range(0, window - 6, 7), window - 7]:
            both = both[packed[x[both] + k] == packed[y[both] + k]]
        hit = np.zeros(len(text), bool)
        hit[x[both]] = hit[y[both]] = True
        for i, s in zip(which.tolist(), begin.tolist()):
            found[i] = hit[s : s + len(found[i])].copy()
    return found
