"""Plain numpy forms of the sequential definitions, for small fixtures."""

import numpy as np

POINT = {
    "hamming": lambda m, x: (m != x).sum(1),
    "l1": lambda m, x: np.abs(m - x).sum(1),
    "l2sq": lambda m, x: ((m - x) ** 2).sum(1),
}
POINT["euclidean"] = POINT["l2sq"]
COST = POINT | {"euclidean": POINT["l1"]}


def seeds(data, k, metric):
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(np.argmax(np.min([POINT[metric](data, data[s]) for s in chosen], axis=0))))
    return chosen


def place(data, medoids, metric):
    placed = np.argmin([POINT[metric](data, data[m]) for m in medoids], axis=0)
    placed[medoids] = -1
    return placed


def update(data, medoids, placed, metric):
    total, moved = 0.0, []
    for c, medoid in enumerate(medoids):
        members = np.where(placed == c)[0]
        if not len(members):
            moved.append(medoid)
            continue
        costs = np.array([COST[metric](data[members], data[m]).sum() for m in members])
        total += costs.sum()
        moved.append(int(members[np.argmin(costs)]))
    return moved, total


def fit(data, k, metric, max_iter=50):
    last, cost = seeds(data, k, metric), np.inf
    placed, history = place(data, last, metric), []
    for _ in range(max_iter):
        moved, now = update(data, last, placed, metric)
        history.append(now)
        if now >= cost:
            break
        last, cost, placed = moved, now, place(data, moved, metric)
    return last, placed, history


def tree(data, ids, k, metric, path=(), out=None):
    """{path: (medoid ids, [member ids per child])} of every inner node."""
    out = {} if out is None else out
    medoids, placed, _ = fit(data, k, metric)
    members = [np.where(placed == c)[0] for c in range(k)]
    out[path] = ([int(ids[m]) for m in medoids], [sorted(int(ids[i]) for i in m) for m in members])
    for c, m in enumerate(members):
        if len(m) > k:
            tree(data[m], ids[m], k, metric, (*path, c), out)
    return out
