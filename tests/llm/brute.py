"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTENCE_END = re.compile(r"""\n|[.!?,;:][!-/:-@\[-`{-~]*(?=[ \t\n\x0b\x0c\r])|[\u3002\uff01\uff1f\uff1b\uff0c\u2026\u061f\u06d4\u061b\u0964\u0965\u1362\u104b]""")
DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def cut(body, gone):
    runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
    kept = bytes(b for b, g in zip(body, gone) if not g)
    return len(body), len(body) - len(kept), runs, sha(kept)


def suffix_dedup(rows, window=100):
    """rows: (doc_id, text) with distinct ids."""
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        body = (text or "").encode()
        gone = [False] * len(body)
        for i in range(len(body) - window + 1):
            part = body[i : i + window]
            if part in seen:
                gone[i : i + window] = [True] * window
            seen.add(part)
        out.append((doc_id, *cut(body, gone)))
    return out


def sentence_dedup(rows, min_words, long_words, every=False):
    """rows: (doc_id, text) with distinct ids; every: take all runs of several sentences, not only the shortest from each."""
    texts, runs = {}, defaultdict(list)
    for doc_id, text in rows:
        body = (text or "").encode()
        spans, at = [], 0
        for stop in [*sorted({m.end() for m in SENTENCE_END.finditer(text or "")}), len(text or "")]:
            part = (text or "")[at:stop]
            if words := WORD.findall(part):
                a = at + WORD.search(part).start()
                b = at + len(part.rstrip(" \t\n\x0b\x0c\r"))
                wide = sum("\u3000" <= c <= "\udfff" for c in part)
                spans.append((len((text or "")[:a].encode()), len((text or "")[:b].encode()), len(words) + wide // 2))
            at = stop
        texts[doc_id] = (body, spans)
        found = set()
        for i in range(len(spans)):
            if spans[i][2] >= long_words:
                found.add((i, i + 1))
            for js, key in ((range(i + 2, len(spans) + 1), lambda j: (i, j)), (range(i - 1, -1, -1), lambda j: (j, i + 1))):
                for j in js:
                    a, b = key(j)
                    if sum(s[2] for s in spans[a:b]) >= min_words:
                        found.add((a, b))
                        if not every:
                            break
        for a, b in found:
            runs[tuple(body[s[0] : s[1]] for s in spans[a:b])].append((doc_id, a, b))
    gone = {doc_id: [False] * len(body) for doc_id, (body, _) in texts.items()}
    for places in runs.values():
        for doc_id, a, b in sorted(places)[1:]:
            body, spans = texts[doc_id]
            for k in range(spans[a][0], spans[b][0] if b < len(spans) else len(body)):
                gone[doc_id][k] = True
    return [(doc_id, *cut(texts[doc_id][0], gone[doc_id])) for doc_id, _ in rows]


def shingles(text):
    words = WORD.findall((text or "").translate(DOWN))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_dedup(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by = defaultdict(list)
    shared = Counter()
    for d, s in sets.items():
        for x in s:
            for other in by[x]:
                shared[other, d] += 1
            by[x].append(d)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
        len(words) < 10 or 100 * len(hit) > 20 * len(words),
    )


def base_secrets(text):
    text, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (name, pattern) in enumerate((("assign", assign), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(pattern, text):
            if len(m[2]) >= 6 if not kind else len(m[0]) >= (20 if kind == 1 else 24):
                out.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    out.sort()
    return (*(sum(k == kind for _, k, _ in out) for kind in range(3)), sha(",".join(x for *_, x in out)), [x for *_, x in out])


def contamination(rows, bench):
    """rows: (doc_id, text); bench: (item_id, text)."""
    items = [(str(i), w) for i, t in bench if (w := TERM.findall((t or "").translate(DOWN)))]
    out = []
    for doc_id, text in rows:
        words = TERM.findall((text or "").translate(DOWN))
        at = defaultdict(list)
        sizes = {min(13, len(w)) for _, w in items}
        for k in sizes:
            for i in range(len(words) - k + 1):
                at[tuple(words[i : i + k])].append(i)
        hit, ids = set(), set()
        for item, w in items:
            k = min(13, len(w))
            for s in range(len(w) - k + 1):
                for i in at.get(tuple(w[s : s + k]), ()):
                    hit.update(range(i, i + k))
                    ids.add(item)
        out.append((doc_id, len(words), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def auc(scores, labels):
    pairs = sorted(zip(scores, labels))
    ranks, i = {}, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        ranks[pairs[i][0]] = (i + j + 1) / 2
        i = j
    good = sum(labels)
    return (sum(ranks[s] for s, y in pairs if y) - good * (good + 1) / 2) / (good * (len(pairs) - good))


def distance(a, b):
    """Edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def near_items(rows, bench, slop=2):
    """doc_id to the number of items with a window whose words all stand within slop places of a diagonal, its rarest on it."""
    docs = [(d, TERM.findall((t or "").translate(DOWN))) for d, t in rows]
    df = Counter(w for _, words in docs for w in words)
    out = {}
    for d, words in docs:
        at, hit = defaultdict(list), set()
        for i, w in enumerate(words):
            at[w].append(i)
        for item, t in bench:
            w = TERM.findall((t or "").translate(DOWN))
            k = min(13, len(w))
            for s in range(len(w) - k + 1) if w else ():
                p = min(range(s, s + k), key=lambda q: (df[w[q]], q))
                if any(all(any(abs(i - q - (x - p)) <= slop for i in at[w[q]]) for q in range(s, s + k)) for x in at[w[p]]):
                    hit.add(item)
        out[d] = len(hit)
    return out
