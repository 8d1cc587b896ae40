"""Breadth-first search one seed after the other."""


def distances(rows, seeds, depth):
    near = {}
    for a, b, *_ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for seed in seeds:
        level, seen = {seed}, {seed}
        found[seed, seed] = 0
        for hop in range(1, depth + 1):
            level = {n for m in level for n in near.get(m, ())} - seen
            seen |= level
            found |= {(seed, n): hop for n in level}
    return found
