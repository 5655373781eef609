"""Plain versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WS = " \t\n\x0b\f\r"
UPPER = {i: i + 32 for i in range(65, 91)}


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def secrets(text: str | None) -> dict:
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    n = [sum(k == x[2] for x in found) for k in ("assign", "access", "hex")]
    return dict(zip(("n_assign", "n_access", "n_hex"), n, strict=True)) | {"base_sha256": sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))}


def warc(pages: list[tuple[int, str | None]]) -> dict:
    first: dict = {}
    for i, html in sorted(pages):
        first.setdefault((html or "").encode(), i)
    out = {}
    for i, html in pages:
        p = (html or "").encode()
        again = first[p] != i
        out[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None)
    return out


def lines(docs: list[tuple[int, str | None]], least: int = 40, many: int = 5) -> dict:
    key = lambda x: x.strip(WS).translate(UPPER)
    where = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(key(x)) >= least and len(where[key(x)]) >= many and max(where[key(x)]) != i)]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept)))
    return out


def shingle_set(text: str | None, n: int) -> set:
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(docs: list[tuple[int, str | None]], n: int = 2, pct: int = 80) -> list[tuple]:
    """Rows of the result, sorted; rows that share a doc_id are one vertex."""
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= pct * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted(((i, len(x), None if i is None else find(i), i is None or find(i) == i) for i, x in sets), key=str)


def repeats(docs: list[tuple[int, str | None]], size: int = 200) -> dict:
    count = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for s in range(len(b) - size + 1):
            count[b[s : s + size]] += 1
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def topk(vectors: list[tuple[int, list | None]], step: int = 100, k: int = 10) -> set:
    import math

    ok = {i: [math.floor(1024 * float(x)) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % step == 0:
            near = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    return out


def resample(docs: list[tuple[int, str | None]], target: list[str | None], buckets: int = 10_000, percent: int = 25, least: int = 20) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank), sorted."""
    import math
    import zlib

    def features(t):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER))
        return len(words), [zlib.crc32(x.encode()) % buckets for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]

    own, other = [(i, *features(t)) for i, t in docs], [features(t)[1] for t in target]
    s, t = defaultdict(int), defaultdict(int)
    for counts, lists in ((s, [f for _, _, f in own]), (t, other)):
        for f in lists:
            for b in f:
                counts[b] += 1
    sums = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * sums[0] / ((s[b] + 1.0) * sums[1])))
    out = []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {id(x): r + 1 for r, x in enumerate(able[: percent * len(able) // 100])}
    return sorted(((i, n, w, v, rank.get(id(x))) for x in out for i, _, n, w, v in [x]), key=str)


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling(docs: list[tuple[int, str | None]], one_in: int = 31, chars: int = 7, least: int = 2, ratio: int = 10) -> set[tuple]:
    """(word, form, root, n, n_near, form_n)."""
    import zlib

    n = defaultdict(int)
    for i, t in docs:
        for run in re.findall("[A-Za-z\xc0-\xff]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= chars and k >= least}

    found = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in found.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(found[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def tiles(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of unmarked tokens, of equal ones those of the lowest diagonal first."""
    used_d, used_i, out = set(), set(), []
    while True:
        runs = []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n >= least:
                    runs.append((n, d, i))
        if not runs:
            return out
        best = max(runs)[0]
        for n, d, i in sorted((r for r in runs if r[0] == best), key=lambda r: (r[1] - r[2], r[1])):
            if not any(d + k in used_d or i + k in used_i for k in range(n)):
                out.append((d, i, n))
                used_d |= set(range(d, d + n))
                used_i |= set(range(i, i + n))
