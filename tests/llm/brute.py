"""Plain versions of the operators, for small inputs. Each takes rows (id, text) and gives {id: result}."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def op2(rows, path, end_id=2):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, {}
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end_id]
        out[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def op3(rows):
    out = {}
    for i, t in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        n = len(w)
        seen = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
        cov = {j for k in range(n - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        out[i] = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), n < 20 or 100 * len(cov) > 30 * n)
    return out


def op4(rows, n=50):
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for k in range(len(data[i]) - n + 1):
            first.setdefault(data[i][k : k + n], i)
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        spans = int((gone[1:].astype(int) - gone[:-1] == 1).sum()) + int(gone[0])
        out[i] = (len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def op5(rows, distance=3):
    fp = {}
    for i, t in rows:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def op7(rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = {}
    for i, t in rows:
        t = t or ""
        found = [[m.span() for m in assign.finditer(t) if len(m[2]) >= 12], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18], [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]]
        spans = sorted((s, k, e) for k, f in enumerate(found) for s, e in f)
        out[i] = (*map(len, found), sha(",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in spans)))
    return out


def op10(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(len(w), size)
        for j in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[j : j + n])].add(str(k))
    lens = {len(g) for g in grams}
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lens:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    hit |= set(range(j, j + n))
                    found |= grams[g]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
