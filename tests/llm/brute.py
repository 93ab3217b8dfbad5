"""Plain single-process versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re


def line_dedup(docs: list[tuple], least: int) -> dict[int, str]:
    """Kept text by doc_id of (doc_id, text): lines of runs of ``least`` words or more that have begun earlier are deleted."""
    seqs = {d: [(x, len(x.split())) for x in (t or "").split("\n") if x.split()] for d, t in docs}
    out = {}
    for d, t in docs:
        mine, drop = seqs[d], set()
        for p in range(len(mine)):
            best = 0
            for e, other in seqs.items():
                if e > d:
                    continue
                for q in range(len(other)):
                    if (e, q) >= (d, p):
                        continue
                    n = 0
                    while p + n < len(mine) and q + n < len(other) and mine[p + n][0] == other[q + n][0]:
                        n += 1
                    best = max(best, n)
            if sum(n for _, n in mine[p:p + best]) >= least:
                drop |= set(range(p, p + best))
        kept, at = [], 0
        for x in (t or "").split("\n"):
            has = bool(x.split())
            if not (has and at in drop):
                kept.append(x)
            at += has
        out[d] = "\n".join(kept)
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_duplicates(docs: list[tuple], threshold: float) -> dict[int, tuple[int, int]]:
    """(class id, links) by doc_id."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    links = dict.fromkeys(up, 0)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (root(d), links[d]) for d in up}


def substring_dedup(docs: list[tuple], n: int = 13) -> dict[int, tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by doc_id."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i:i + n]), d)
    out = {}
    for d, w in words.items():
        drop = {j for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] < d for j in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        out[d] = (len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    return out
