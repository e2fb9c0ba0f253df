"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def repeats(rows, length=50):
    """doc_id -> (n_words, n_removed, kept_sha256) by comparing every window."""
    first = {}
    for doc, text in rows:
        ws = words(text)
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i : i + length])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shingles(text, n=5):
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def groups(rows, threshold=0.8):
    """(doc_id, class_id, links to different shingle sets) by comparing all pairs."""
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=lambda s: min(d for d, x in sets if x == s))
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(distinct)
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    place = {s: i for i, s in enumerate(distinct)}
    least = {}
    for d, s in sets:
        if s:
            root = find(place[s])
            least[root] = min(least.get(root, d), d)
    return sorted((d, least[find(place[s])], links[place[s]]) if s else (d, d, 0) for d, s in sets)
