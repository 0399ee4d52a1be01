"""Plain Python versions of the contracts, for small inputs. Each takes (doc_id, text) rows and gives {doc_id: result}."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def url(u):
    u = u or ""
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:n].translate(LOWER), rest[n:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def judge(u):
    host, path = url(u)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(x in host + path for x in ("cheap-pills.", "free-bets.", "spam-farm.", "ads-track."))
    return host, path, None, "block" if bad else "allow"


def words_of(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def quality(text):
    text = text or ""
    w = words_of(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    lines = sum(1 for x in text.split("\n") if words_of(x))
    n, sym = len(w), sum(c in "#*$%&|<>" for c in text)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, w)), sym, dup, len(hit), failed, not failed and not sym > n, lines


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secrets(rows):
    """rows: (doc_id, source, text) -> {doc_id: (n_assign, n_access, n_hex, base_sha256, spans)}"""
    owners, found = defaultdict(set), {}
    for d, s, t in rows:
        base = base_spans(t)
        extra = [(m.start(), 3, "opaque", m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or "") if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        extra = [x for x in extra if not any(y[0] < x[3] and x[0] < y[3] for y in base)]
        found[d] = base, extra
        for x in base + extra:
            owners[x[4]].add(s)
    show = lambda xs: ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted(xs))
    out = {}
    for d, (base, extra) in found.items():
        n = Counter(x[2] for x in base)
        out[d] = n["assign"], n["access"], n["hex"], sha(show(base)), show(base + [x for x in extra if len(owners[x[4]]) == 1])
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, bench):
    windows = defaultdict(set)
    for k, t in bench:
        w = bench_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = bench_words(t)
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[x]
        out[d] = len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)
    return out


def repeats(docs, size=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if (k := b[i : i + size]) in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(k)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = len(b), sum(gone), spans, sha(kept)
    return out


def near(docs, size=2, percent=80):
    """{doc_id: (n_shingles, component_id, kept)}"""
    sets = {}
    for d, t in docs:
        w = words_of((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[(a, b)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
