"""Plain, slow versions of the operators' contracts."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def pages(rows):
    first = {}
    for i, h in rows:
        k = (h or "").encode()
        first[k] = min(first.get(k, i), i)
    out = {}
    for i, h in rows:
        k = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(k).digest()).decode()
        out[i] = (len(k), d, "response" if first[k] == i else "revisit", None if first[k] == i else first[k])
    return out


def personal(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    spans = ",".join(f"{k}:{s}:{e}" for k, v in out.items() for s, e in v)
    return tuple(len(v) for v in out.values()) + (sha(spans),), spans


def secret(text):
    t, out = text or "", []
    kw = r"(password|passwd|secret|token|api_?key)"
    for m in re.finditer("(?ia:" + kw + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    out.sort()
    n = [sum(x[1] == k for x in out) for k in range(3)]
    return (*n, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in out)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s : s + n])].add(i)
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if got := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def simhash(text, k=4):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, most=4):
    fps = {d: simhash(t) for d, t in docs}
    up = {d: d for d in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def alike(docs, k=5, least=0.8):
    """Smallest id reachable over texts whose k-word shingles are similar."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    rep = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    covered, longest = repeats(w, 3)
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), failed, not failed and covered <= 0.65 * len(w) and longest <= 50


def repeats(w, least):
    """(words inside `least`-word windows that occur twice, words of the longest repeat)."""
    at, covered = defaultdict(list), set()
    for i in range(len(w) - least + 1):
        at[tuple(w[i : i + least])].append(i)
    for v in at.values():
        if len(v) > 1:
            covered |= {p for i in v for p in range(i, i + least)}
    lo, hi = 0, len(w) - 1  # the longest m for which some window of m words occurs twice
    while lo < hi:
        m = (lo + hi + 1) // 2
        seen = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        lo, hi = (m, hi) if len(seen) < len(w) - m + 1 else (lo, m - 1)
    return len(covered), lo if lo >= least else 0


def licenses(text):
    w = WORD.findall(lower(text))
    places, labels = [], set()
    for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def notices(text, wanted):
    """(labels of notices that stand in the text within their errors, best score): one search of the whole text a notice."""
    import regex

    joined = " ".join(WORD.findall(lower(text)))
    labels, score = set(), 0.0
    for n in wanted:
        for m in regex.finditer(f"(?e)(?:{regex.escape(n.text)}){{e<={n.errors}}}", joined, regex.V0):
            if m.end() > m.start():
                labels.add(n.label)
                score = max(score, 1 - sum(m.fuzzy_counts) / len(n.text))
    return labels, score


def pack_ids(text, tok, end=2, size=1024):
    import struct

    ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
    first, out, at = len(ids) % size or size, [], 0
    while at < len(ids):
        n = first if at == 0 else size
        out.append((len(out), at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))))
        at += n
    return out


def cut_chunks(data, reach=28, longest=1024):
    """Chunk ends of a byte string: after a byte whose gear hash is the smallest within reach on both sides."""
    from marginalia.llm.chunks import GEAR

    n, h, hashes = len(data), 0, []
    for b in data:
        h = (2 * h + int(GEAR[b])) % 2**32
        hashes.append(h)
    cuts = {0, n}

    def whole(at):
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    if n > 2 * reach + 1:
        for p in range(reach, n - reach):
            if hashes[p] < min(hashes[p - reach : p]) and hashes[p] <= min(hashes[p + 1 : p + reach + 1]):
                cuts.add(whole(p + 1))
    for a, b in zip(sorted(cuts), sorted(cuts)[1:]):
        cuts |= {whole(at) for at in range(a + longest, b, longest)}
    return sorted(cuts)


def passages(docs, least=100):
    """(id, start, end, n_chunks, n_bytes, first ids, is_first, again) of repeated passages; docs: {id: text}."""
    spans, holders = {}, defaultdict(list)
    for d, t in docs.items():
        data = (t or "").encode()
        c = cut_chunks(data) if data else []
        spans[d] = []
        for a, b in zip(c, c[1:]):
            s, e = len(data[:a].decode()), len(data[:b].decode())
            spans[d].append((data[a:b], s, e))
            holders[data[a:b]].append((d, s, e))
    out = []
    for d, chunks in spans.items():
        runs = []
        for piece, s, e in chunks:
            if len(holders[piece]) > 1:
                again = any(x[0] == d and x[1] < s for x in holders[piece])
                if runs and runs[-1][-1][2] == s:
                    runs[-1].append((piece, s, e, again))
                else:
                    runs.append([(piece, s, e, again)])
        for run in runs:
            t = docs[d]

            def grown(at, piece, own, back):
                known = sorted(holders[piece])
                o = known[-1] if known[0][:2] == (d, own) else known[0]
                x, y = (t[:at][::-1], docs[o[0]][: o[1]][::-1]) if back else (t[at:], docs[o[0]][o[2] :])
                n = 0
                while n < min(len(x), len(y)) and x[n] == y[n]:
                    n += 1
                return n

            left, right = grown(run[0][1], *run[0][:2], True), grown(run[-1][2], *run[-1][:2], False)
            start, end = run[0][1] - left, run[-1][2] + right
            if len(t[start:end].encode()) < least:
                continue
            parts = []
            for x in run:
                if parts and parts[-1][-1][3] == x[3]:
                    parts[-1].append(x)
                else:
                    parts.append([x])
            for i, part in enumerate(parts):
                first = sorted({min(holders[p])[0] for p, *_ in part})
                a, b = (start if i == 0 else part[0][1]), (end if i == len(parts) - 1 else part[-1][2])
                out.append((d, a, b, len(part), sum(len(p) for p, *_ in part), tuple(first), first == [d], part[0][3]))
    return sorted(out)


def expectation_maximisation(patterns, kinds, rounds=20):
    """Posteriors of patterns (kind, votes, n) by the textbook rule: two classes, votes independent given the class, counts smoothed by one."""
    pi = [0.5] * kinds
    a = [{-1: 0.1, 0: 0.4, 1: 0.5} for _ in range(4)]
    b = [{-1: 0.5, 0: 0.4, 1: 0.1} for _ in range(4)]

    def posterior():
        out = []
        for k, votes, _ in patterns:
            yes, no = pi[k], 1 - pi[k]
            for j, v in enumerate(votes):
                yes, no = yes * a[j][v], no * b[j][v]
            out.append(yes / (yes + no))
        return out

    for _ in range(rounds):
        q = posterior()
        for k in range(kinds):
            pi[k] = (sum(n * x for (kk, _, n), x in zip(patterns, q) if kk == k) + 1) / (sum(n for kk, _, n in patterns if kk == k) + 2)
        for table, w in ((a, q), (b, [1 - x for x in q])):
            total = sum(n * x for (_, _, n), x in zip(patterns, w))
            for j in range(4):
                for v in (-1, 0, 1):
                    table[j][v] = (sum(n * x for (_, votes, n), x in zip(patterns, w) if votes[j] == v) + 1) / (total + 3)
    return posterior()


def personal_spans(texts):
    """op2's spans by plain loops: candidates, votes, expectation-maximisation, naive Bayes."""
    import math

    from marginalia.llm import pii

    kinds = [k for k, *_ in pii.EXTRA]
    found = {}
    for d, t in texts.items():
        rows = []
        for m in re.finditer(pii._LOOSE, t):
            v, before, after = m[0], t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + 1]
            k = next(i for i, (_, p, _, _) in enumerate(pii.EXTRA) if re.fullmatch(p, v))
            has = lambda words, pattern: re.search(pattern % "|".join(words), v) is not None  # noqa: E731, B023
            known = {
                "name": int(has(pii.NAMES, r"(?:^|\x20)(?:%s)(?:\x20|$)")), "account": 1 if has(pii.COUNTRIES, "^(?:%s)") else -1,
                "number": int(has(pii.ISSUERS, "^(?:%s)")), "street": int(has(pii.STREETS, "(?:%s)$")),
            }.get(kinds[k], 0)
            shape = 1 if re.search(pii.EXTRA[k][2], v) else -1
            cue = int(re.search(rf"(?i)\b(?:{pii.EXTRA[k][3]})\b", before, re.A) is not None)
            counter = -int(re.search(r"(?i)(?:order|version|invoice|isbn|issue|page|no\.|#|\$|v)\s*$", before) is not None)
            bits = (re.search(r"(?:^|[\s(,;:])$", before), re.search(r"^[\s,.;:)!?]?$", after), re.search(r"[:=]\s*$", before))
            rows.append((k, (shape, known, cue, counter), tuple(int(b is not None) for b in bits), m.start(), m.end()))
        found[d] = rows
    counts = defaultdict(int)
    for rows in found.values():
        for r in rows:
            counts[r[:3]] += 1
    patterns = sorted(counts)
    n = [counts[p] for p in patterns]
    q = expectation_maximisation([(k, v, c) for (k, v, _), c in zip(patterns, n)], len(kinds))

    def score(w, k, votes, bits):
        total = sum(w)
        share = lambda test, cells: (sum(x for x, p in zip(w, patterns) if test(p)) + 1) / (total + cells)
        out = math.log(total + 1) + math.log(share(lambda p: p[0] == k, len(kinds)))
        out += sum(math.log(share(lambda p, j=j, v=v: p[1][j] == v, 3)) for j, v in enumerate(votes))
        for j, b in enumerate(bits):
            one = share(lambda p, j=j: p[2][j] == 1, 2)
            out += math.log(one if b else 1 - one)
        return out

    yes, no = [x * c for x, c in zip(q, n)], [(1 - x) * c for x, c in zip(q, n)]
    good = {p for p in patterns if score(yes, *p) > score(no, *p)}
    spans = {}
    for d, t in texts.items():
        base = [x.split(":") for x in personal(t)[1].split(",") if x]
        free = [r for r in found[d] if r[:3] in good and not any(int(a) < r[4] and r[3] < int(b) for _, a, b in base)]
        spans[d] = [(k, int(a), int(b)) for k, a, b in base] + [(kinds[k], a, b) for k, _, _, a, b in sorted(free, key=lambda r: (r[0], r[3]))]
    return spans
