"""Plain versions of the operators for small inputs, written apart from them."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1
               for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def base_failed(text):
    c = counts(text)
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def kept(text):
    c, text = counts(text), text or ""
    upper = len(re.findall("[A-Z]", text))
    letters = len(re.findall("[A-Za-z]", text))
    marks = text.count("!") + text.count("?")
    return not (base_failed(text) or 10 * c["n_symbols"] > c["n_words"] or 2 * upper > letters
                or 10 * marks > 3 * c["n_words"]
                or not 2 * c["n_words"] <= c["word_chars"] <= 15 * c["n_words"])


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Smallest reachable id by id, from fingerprints by id."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def contaminated(text, items):
    """(n_words, hit places, item ids) by comparing every window with every window."""
    def plain(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    words, hit, found = plain(text), set(), set()
    for name, item in items:
        own = plain(item)
        m = min(13, len(own))
        wanted = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i:i + m]) in wanted:
                hit.update(range(i, i + m))
                found.add(str(name))
    return len(words), hit, sorted(found)


def jump(key, shards):
    at, move = -1, 0
    while move < shards:
        at = move
        key = (key * 2862933555777941757 + 1) % 2**64
        move = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def shard(doc_id, shards):
    return jump(xxhash.xxh64_intdigest(str(doc_id).encode(), 42), shards)


def removed(texts, length=400):
    """Per id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    data = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(x[i:i + length] for x in data.values() for i in range(len(x) - length + 1))
    out = {}
    for d, x in data.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        stay = bytes(b for b, g in zip(x, gone) if not g)
        out[d] = (len(x), sum(gone), runs, hashlib.sha256(stay).hexdigest())
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def mix_targets(sizes, weights=(5, 2, 1)):
    """Targets by sharing out again and again what full sources can't take."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, list(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target
