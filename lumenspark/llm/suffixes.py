"""Deep-shallow sorting of byte strings, and the repeats among strings that are aligned at an anchor.

Sorting: multikey quicksort on chunks of bytes down to a shallow depth; groups that still agree there go into a blind trie,
which branches on one byte per node and compares whole strings only once for each insertion.
"""

from __future__ import annotations

from bisect import bisect_left, insort

#: Bytes that multikey quicksort takes as one character; depth from which blind tries go on.
CHUNK, SHALLOW = 8, 128


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the longest common prefix, at least ``low``."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 16
    while low + step < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return low


class _Node:
    __slots__ = ("ends", "kids", "skip")

    def __init__(self, skip: int) -> None:
        self.skip, self.kids, self.ends = skip, {}, []


class BlindTrie:
    """Order of strings with long common prefixes.  Inner nodes hold a depth and the bytes there (-1: the string ends)."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node, path = self.root, []
        while isinstance(node, _Node):  # blindly: only the branching bytes are looked at
            path.append(node)
            byte = s[node.skip] if node.skip < len(s) else -1
            node = node.kids.get(byte) or next(iter(node.kids.values()))
        other = self.strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        parent = None
        for at in path:
            if at.skip > depth:
                break
            parent = at
        byte, theirs = (t[depth] if depth < len(t) else -1 for t in (s, other))
        if parent is not None and parent.skip == depth:
            parent.kids[byte] = [i]
            return
        new = _Node(depth)
        if parent is None:
            below, self.root = self.root, new
        else:
            key = s[parent.skip] if parent.skip < len(s) else -1
            below, parent.kids[key] = parent.kids[key], new
        new.kids[theirs], new.kids[byte] = below, [i]

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, _Node):
                stack += [node.kids[b] for b in sorted(node.kids, reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], members: list[int] | None = None, depth: int = 0) -> list[int]:
    """The places of the strings in ascending order."""
    out: list[int] = []
    stack = [(list(range(len(strings))) if members is None else members, depth)]
    while stack:
        group, at = stack.pop()
        if len(group) < 2:
            out += group
        elif at >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.ordered()
        else:
            pivot = strings[group[len(group) // 2]][at : at + CHUNK]
            less, same, more = [], [], []
            for i in group:
                key = strings[i][at : at + CHUNK]
                (same if key == pivot else less if key < pivot else more).append(i)
            # strings that end within this chunk are equal
            stack += [(more, at), (same, at + CHUNK if len(pivot) == CHUNK else SHALLOW), (less, at)]
    return out


def repeats(entries: list[tuple[bytes, int]], length: int, owners: list | None = None, unit: int = 1) -> list[set[tuple[int, int]]]:
    """For each entry (bytes, place of the anchor in them) the intervals of starts, relative to the anchor as distances to
    the left (low, high), of windows of ``length`` bytes about the anchor that another entry has at the same distance.
    With ``owners``, an entry of another owner.  ``unit``: bytes of a character, where strings are of wider characters.

    Equal entries are one string, which repeats as a whole (where it has two owners, and then differs from any).
    """
    alike: dict[tuple[bytes, int], list[int]] = {}
    for i, entry in enumerate(entries):
        alike.setdefault(entry, []).append(i)
    strings, holders, found = list(alike), [], []
    for (s, at), members in alike.items():
        several = len(members) > 1 if owners is None else any(owners[i] != owners[members[0]] for i in members)
        holders.append(object() if several or owners is None else owners[members[0]])
        low, high = max(0, length - len(s) + at), min(at, length)
        found.append({(low, high)} if several and low <= high else set())
    if len(strings) > 1:
        _compared(strings, length, holders, unit, found)
    out: list[set[tuple[int, int]]] = [set()] * len(entries)
    for members, spans in zip(alike.values(), found, strict=True):
        for i in members:
            out[i] = spans
    return out


def _compared(entries: list[tuple[bytes, int]], length: int, owners: list, unit: int, found: list[set[tuple[int, int]]]) -> None:
    """Adds to ``found`` what different strings have in common.

    Entries sorted by what follows the anchor are united from the longest common prefix down.  A united set keeps its members
    by the order of what precedes the anchor (reversed), and each member of the smaller set meets its neighbours in the
    larger one: a pair that is not adjacent is covered by a pair within the larger set that agrees on more on both sides.
    (Of one owner's run of members all are met, through the first of a second owner, so a covering pair has two owners.)
    """
    n = len(entries)
    after = [e[at:] for e, at in entries]
    before = [e[:at][::-1] for e, at in entries]

    def met(i: int, j: int, same_after: int) -> bool:
        same_before = common_prefix(before[i], before[j]) // unit * unit
        if same_before + same_after < length:
            return False
        if owners[i] != owners[j]:
            span = max(0, length - same_after), min(same_before, length)
            found[i].add(span)
            found[j].add(span)
        return True

    if n == 2:
        met(0, 1, common_prefix(after[0], after[1]) // unit * unit)
        return
    order = deep_shallow(after)
    by_left = deep_shallow(before)
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    steps = sorted(((common_prefix(after[a], after[b]) // unit * unit, k) for k, (a, b) in enumerate(zip(order, order[1:], strict=False))), reverse=True)
    owner = list(range(n))  # of places in ``order``
    sets = [[rank[i]] for i in order]

    def top(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for same_after, k in steps:
        a, b = top(k), top(k + 1)
        if len(sets[a]) > len(sets[b]):
            a, b = b, a
        small, large = sets[a], sets[b]
        for r in small:
            i = by_left[r]
            if same_after + len(before[i]) < length:
                continue
            at = bisect_left(large, r)
            for start, step in ((at - 1, -1), (at, 1)):
                run = None
                while 0 <= start < len(large):
                    j = by_left[large[start]]
                    if not met(i, j, same_after) or (run is not None and owners[j] != run):
                        break
                    run = owners[j]
                    start += step
        if len(small) * 16 < len(large):
            for r in small:
                insort(large, r)
        else:
            large += small
            large.sort()  # two ascending runs: linear
        owner[a], sets[a] = b, []
