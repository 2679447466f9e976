"""Plain definitions to compare with."""

from collections import defaultdict


def occurrences(traces, grp, max_len=None):
    """Every subsequence of a group with its places."""
    found = defaultdict(list)
    for (g, t), s in traces.items():
        if g != grp:
            continue
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if max_len is None or j - i <= max_len:
                    found[tuple(s[i:j])].append((t, i))
    return found


def contains(longer, shorter):
    n = len(shorter)
    return len(longer) > n and any(longer[i : i + n] == shorter for i in range(len(longer) - n + 1))


def supermaximal(traces, grp):
    repeats = {w: places for w, places in occurrences(traces, grp).items() if len(places) >= 2}
    return {w: p for w, p in repeats.items() if not any(contains(x, w) for x in repeats)}


def profile(traces, grp):
    """``{w: (n_occ, n_left, n_right, n_witness)}`` of all repeats."""
    out = {}
    for w, places in occurrences(traces, grp).items():
        if len(places) < 2:
            continue
        left, right = [], []
        for t, i in places:
            s = traces[(grp, t)]
            left.append(s[i - 1] if i else ("L", t))
            right.append(s[i + len(w)] if i + len(w) < len(s) else ("R", t))
        witness = sum(left.count(a) == 1 and right.count(b) == 1 for a, b in zip(left, right))
        out[w] = (len(places), len(set(left)), len(set(right)), witness)
    return out


def is_power(w):
    return any(len(w) % d == 0 and w == w[:d] * (len(w) // d) for d in range(1, len(w)))


def squares(s, max_period):
    """0-based ``(start, period)``."""
    return [
        (i, p)
        for p in range(1, max_period + 1)
        for i in range(len(s) - 2 * p + 1)
        if s[i : i + p] == s[i + p : i + 2 * p]
    ]


def runs(s, max_period):
    """Maximal runs of primitive squares ``(period, start, stop, reps)``, 0-based."""
    out = []
    for p in range(1, max_period + 1):
        starts = [i for i, q in squares(s, p) if q == p and not is_power(s[i : i + p])]
        for i in starts:
            if i - 1 not in starts:
                j = i
                while j + 1 in starts:
                    j += 1
                out.append((p, i, j + 2 * p, (j + 2 * p - i) // p))
    return out


def collapse(s, period):
    drop = set()
    for p, a, _, reps in runs(s, period):
        if p == period:
            drop.update(range(a + p, a + reps * p))
    return [x for i, x in enumerate(s) if i not in drop]


def score(pattern, s):
    best = 0
    for i in range(len(s)):
        k = 0
        while k < len(pattern) and i + k < len(s) and s[i + k] == pattern[k]:
            k += 1
        best = max(best, k)
    return best
