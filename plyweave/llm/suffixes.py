"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then a blind trie for each group that is
still equal there. Both return the order and the common prefix of each string with the one before it."""

from __future__ import annotations

SHALLOW, STEP = 32, 8


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, the first `at` bytes being equal."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return min(at, n)


def blind_trie(strings: list[bytes], ids: list[int], at: int) -> list[int]:
    """ids in the order of their strings, whose first `at` bytes are equal.

    Inner nodes hold a depth and one child a byte (-1: the string ends); a descent reads only the branching bytes, and
    one comparison with the leaf it meets tells the depth at which the string belongs.
    """
    root: list = [at, {}]
    byte = lambda s, d: s[d] if d < len(s) else -1
    for i in ids:
        s, node = strings[i], root
        while isinstance(node, list) and node[1]:
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        if isinstance(node, list):
            node[1][byte(s, at)] = (i,)
            continue
        t = strings[node[0]]
        depth = common(s, t, at)
        if depth == len(s) == len(t):
            parent, here = root, root[1][byte(s, at)]
            while isinstance(here, list):
                parent, here = here, here[1][byte(s, here[0])]
            parent[1][byte(s, parent[0])] = (*here, i)
            continue
        parent, here = None, root
        while isinstance(here, list) and here[0] < depth:
            parent, here = here, here[1].get(byte(s, here[0]))
        if isinstance(here, list) and here[0] == depth:
            here[1][byte(s, depth)] = (i,)
        elif here is None:
            parent[1][byte(s, parent[0])] = (i,)
        else:
            parent[1][byte(s, parent[0])] = [depth, {byte(t, depth): here, byte(s, depth): (i,)}]
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            out += node
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, and for each place the common prefix with the place before (0 at the first)."""
    order: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        ids, at = todo.pop()
        if len(ids) < 2:
            order += ids
        elif at >= SHALLOW:
            order += blind_trie(strings, ids, at)
        else:
            keys = {i: strings[i][at : at + STEP] for i in ids}
            pivot = keys[ids[len(ids) // 2]]
            less, same, more = ([i for i in ids if keys[i] < pivot], [i for i in ids if keys[i] == pivot], [i for i in ids if keys[i] > pivot])
            ended = len(pivot) < STEP
            todo += [(more, at), (same, SHALLOW if ended else at + STEP), (less, at)]
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))][: len(order)]
