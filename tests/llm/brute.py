"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(docs, k=5, percent=75):
    """{doc_id: (n_shingles, component_id, kept)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(x, k) for i, x in docs}
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    both = collections.Counter((a, b) for l in having.values() for n, a in enumerate(l) for b in l[n + 1 :])
    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def substring(docs, n=13):
    """{doc_id: (n_words, n_removed, sha256 of the kept words)}."""
    first, all_words = {}, {i: words(x) for i, x in docs}
    for i in sorted(all_words):
        w = all_words[i]
        for j in range(len(w) - n + 1):
            first.setdefault(tuple(w[j : j + n]), i)
    out = {}
    for i, w in all_words.items():
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone.update(range(j, j + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def placed(key, shards):
    """(region, rack, shard) by weighted hash draws among the children at each level."""
    way = ()
    for depth in range(3):
        below = collections.Counter()
        for s in shards:
            path = (s.region, s.rack, s.shard)
            if s.weight > 0 and path[:depth] == way:
                below[path[: depth + 1]] += s.weight
        draw = {}
        for child, weight in below.items():
            digest = hashlib.md5(f"{'/'.join(map(str, child))}:{key}".encode()).hexdigest()
            draw[child] = -math.log((int(digest[:13], 16) + 0.5) / 2**52) / weight
        way = min(below, key=lambda c: (draw[c], c))
    return way


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def contained(docs, items, percent=75):
    """{doc_id: items found}."""
    sets = [(i, shingles(x)) for i, x in items]
    out = {}
    for i, x in docs:
        s = shingles(x)
        out[i] = sorted(k for k, v in sets if v and 100 * len(v & s) >= percent * len(v))
    return out


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def licenses(text, phrases, templates, percent=80):
    """(n_words, n_base, first_word, last_word, base_labels, labels, blocks)."""
    w, places, base, more, blocks = license_words(text), [], set(), set(), []
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    for n, line in enumerate((text or "").split("\n")):
        s = set(license_words(line))
        for t, label in templates.items():
            own = set(t.split())
            if 100 * len(own & s) >= percent * len(own):
                more.add(label)
                blocks.append((n, label, len(own & s) / len(own)))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), sorted(blocks)


def license_windows(text, templates, percent=80):
    """[(line, label, containment)] of the fullest of overlapping windows of words that meet a template."""
    text, out = text or "", []
    spans = [(m.group(), m.start()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))]
    for t, label in templates.items():
        own, width, hits = set(t.split()), len(t.split()) * 5 // 4, []
        for i, (w, _) in enumerate(spans):
            if w in own:
                window = [x for x, _ in spans[i : i + width]]
                shared = own & set(window)
                if 100 * len(shared) >= percent * len(own):
                    hits.append((i, i + 1 + max(window.index(x) for x in shared), len(shared)))
        while hits:
            i, end, n = max((h for h in hits if h[0] < hits[0][1]), key=lambda h: (h[2], -h[0]))
            out.append((text.count("\n", 0, spans[i][1]), label, n / len(own)))
            hits = [h for h in hits if h[0] >= end]
    return sorted(out)
