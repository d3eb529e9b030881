"""Plain versions of operators, for small tables."""

from collections import Counter, defaultdict


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def shingle_weights(text, inverse):
    """Counter of (runs of five words) weighted by the class of each run's hash."""
    import numpy as np

    from tallyspark.llm import near_dedup

    words = text.lower().split()
    runs = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    out = {}
    for run, n in runs.items():
        h, _ = near_dedup.shingles(near_dedup._Words(), " ".join(run))
        out[run] = n * float(inverse[int(h[0] >> np.uint64(64 - near_dedup.CLASS_BITS))])
    return out


def near_classes(rows, inverse, threshold=0.8):
    """rows: (id, text). {id: (smallest id, rows) of its class}, from all pairs of texts that share a run of words."""
    texts = sorted({t or "" for _, t in rows})
    number = {t: i for i, t in enumerate(texts)}
    weights = [shingle_weights(t, inverse) for t in texts]
    sums = [sum(w.values()) for w in weights]
    holders, links = defaultdict(list), []
    for i, w in enumerate(weights):
        shared = Counter()
        for run, x in w.items():
            for j in holders[run]:
                shared[j] += min(x, weights[j][run])
            holders[run].append(i)
        links += [(j, i) for j, low in shared.items() if low >= threshold * (sums[i] + sums[j] - low)]
    root = classes(len(texts), links)
    members = defaultdict(list)
    for i, t in rows:
        members[root[number[t or ""]]].append(i)
    return {i: (min(m), len(m)) for m in members.values() for i in m}
