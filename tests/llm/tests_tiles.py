"""Greedy string tiling word by word, for comparison."""


def tiles(doc, item, k=4):
    k = min(k, len(item))
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_d and q + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < max(1, k):
            return covered
        n, p, q = best
        used_d.update(range(p, p + n))
        used_i.update(range(q, q + n))
        covered += n
