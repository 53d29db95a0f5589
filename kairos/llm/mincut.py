"""Two labels for the nodes of a small graph by a minimum cut."""

from __future__ import annotations

from collections import deque


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of the minimum cut.

    A node with gain g > 0 is tied to the source by g, with g < 0 to the sink
    by -g; an edge (i, j, w) costs w where its ends get different labels. Of
    several minimum cuts the one with the fewest nodes on the source side is
    returned.
    """
    n = len(gain)
    near: list[dict] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    gain = list(gain)
    label: list = [None] * n
    slack = [sum(x.values()) for x in near]
    # A node whose own tie outweighs all its edges has one label in every
    # minimum cut; its edges then count for its neighbours' ties.
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > slack[i]:
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    slack[j] -= w
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        source = _flow(left, gain, near, label)
        for i in left:
            label[i] = i in source
    return label


def _flow(left: list[int], gain: list[int], near: list[dict], label: list) -> set:
    """Maximum flow (shortest augmenting layers) over the open nodes; returns
    the nodes that the source still reaches."""
    s, t = -1, -2
    room: dict = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in left}
    room[s], room[t] = {}, {}
    for i in left:
        if gain[i] > 0:
            room[s][i], room[i][s] = gain[i], 0
        elif gain[i] < 0:
            room[i][t], room[t][i] = -gain[i], 0
    while True:
        depth, todo = {s: 0}, deque([s])
        while todo:
            i = todo.popleft()
            for j, w in room[i].items():
                if w and j not in depth:
                    depth[j] = depth[i] + 1
                    todo.append(j)
        if t not in depth:
            return set(depth) - {s}
        after = {i: list(room[i]) for i in depth}  # edges not yet used up
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= push
                    room[b][a] = room[b].get(a, 0) + push
                    if cut is None and not room[a][b]:
                        cut = k
                del path[cut + 1:]
                continue
            while after[i] and not (room[i][after[i][-1]] and depth.get(after[i][-1], -1) == depth[i] + 1):
                after[i].pop()
            if after[i]:
                path.append(after[i][-1])
            else:
                depth[i] = -1  # a dead end
                path.pop()

