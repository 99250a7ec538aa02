"""Plain versions of the operators' results, written from their definitions alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return SPACE.findall(text or "")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def repeated_words(words, size=5):
    spots = defaultdict(list)
    for i in range(len(words) - size + 1):
        spots[tuple(words[i : i + size])].append(i)
    return len({i + k for where in spots.values() if len(where) > 1 for i in where for k in range(size)})


def quality(text):
    words = space_words(text)
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words),
    }


def contamination(text, items, size=13):
    words, hit, met = alnum_words(text), set(), set()
    for item, body in items:
        other = alnum_words(body)
        k = min(size, len(other))
        if not k:
            continue
        windows = {tuple(other[i : i + k]) for i in range(len(other) - k + 1)}
        spots = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in windows]
        if spots:
            met.add(str(item) if item is not None else "")
        hit |= {i + j for i in spots for j in range(k)}
    return {
        "n_words": len(words), "n_hit": len(hit), "n_items": len(met), "items_sha256": hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(),
        "contaminated": len(hit) > 0 and 20 * len(hit) >= len(words),
    }


def simhash(text, size=4):
    words = space_words((text or "").translate(LOWER))
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=4):
    """Smallest doc_id reachable over fingerprints within the radius; rows are (doc_id, fp)."""
    root = {fp: fp for _, fp in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for doc, fp in rows:
        least[find(fp)] = min(doc, least.get(find(fp), doc))
    return {doc: least[find(fp)] for doc, fp in rows}


def jump_hash(key, buckets):
    key, b, j = key % 2**64, -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())


def repeats(docs, size=50):
    """doc_id to (repeated words, removed words) as sets of places; docs are (doc_id, text)."""
    spots = defaultdict(list)
    words = {d: space_words(t) for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            spots[tuple(words[d][i : i + size])].append((d, i))
    both, later = defaultdict(set), defaultdict(set)
    for where in spots.values():
        for n, (d, i) in enumerate(where):
            if len(where) > 1:
                both[d] |= set(range(i, i + size))
                if n:
                    later[d] |= set(range(i, i + size))
    return {d: (both[d], later[d]) for d in both}


def line_dedup(docs, window=3):
    """Texts after the removal of later windows; docs are (doc_id, text)."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if SPACE.search(x)]
        gone = set()
        for k in range(len(worded) - window + 1):
            key = tuple(lines[i] for i in worded[k : k + window])
            if key in seen:
                gone |= set(worded[k : k + window])
            seen.add(key)
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def perspectives(turns):
    """(conv, speaker) to (text, mask); turns are (conv, turn, role, text)."""
    by = defaultdict(set)
    for c, n, r, t in turns:
        by[c].add((n, r or "unknown", t or ""))
    out = {}
    for c, said in by.items():
        for who in {r for _, r, _ in said} - {"system"}:
            text = mask = ""
            for _, r, t in sorted(said, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{x[1]}\n{x[2]}".encode()).hexdigest())):
                head = "assistant" if r == who else "system" if r == "system" else f"user name={r}"
                text += f"<|start|>{head}\n{t}<|end|>\n"
                mask += str(int(r == who))
            out[c, who] = text, mask
    return out


