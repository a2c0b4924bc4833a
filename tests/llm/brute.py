"""Plain Python versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re

import xxhash
import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text, bands, chunk, bad_share):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    raw = text.encode()

    def out_of_band(part):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part) if part else 0
        limits = [b for b in bands if len(part) >= b[0]]
        return bool(limits) and (ratio < limits[-1][1] or ratio > limits[-1][2])

    parts = [raw[i:i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    parts = [p for p in parts if len(p) >= bands[0][0]]
    bad = sum(map(out_of_band, parts))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    kept = not failed and not out_of_band(raw) and not bad > bad_share * len(parts)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), failed, kept)


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=4):
    """Index of the class of each fingerprint: the first index that is reachable."""
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text):
    """Valid strict spans as (kind, start, stop), in the order of the contract."""
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text, spans):
    if text is None:
        return None
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], list(PII).index(s[0]))):
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def hash60(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def mix(rows):
    """rows: (doc_id, source, size) -> {(source, hash): copies}, targets by source."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(size.values()), set(sources), {}
    while open_:  # give out what is left by weight; the full ones stop
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    copies = {}
    for s in sources:
        for epoch in range(2):
            budget, used = min(float(size[s]), max(0.0, target[s] - epoch * size[s])), 0
            groups = {}
            for d, x, n in rows:
                if x == s:
                    groups[hash60(d)] = groups.get(hash60(d), 0) + n
            for h in sorted(groups):
                n = groups[h]
                if used + n <= budget or used < budget and used + n - budget < budget - used:
                    copies[s, h] = copies.get((s, h), 0) + 1
                used += n
    return copies, target
