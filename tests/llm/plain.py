"""Plain-Python versions of what the training-data operators compute, for comparison."""

import hashlib
import math
import re
from collections import defaultdict

from sieveline.llm import language, mixing, quality


def plain_mix(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_hash(word):
    odd, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
    if len(word) > 64:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    h = plain_mix(len(word) + odd & m)
    for i in range(0, len(word), 8):
        h = plain_mix((h ^ int.from_bytes(word[i : i + 8], "little")) * odd & m)
    return h


def plain_tokens(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0D]+", (text or "").encode())


def plain_rows(text):
    tokens = plain_tokens(text)
    letters = [bool(re.match(rb"[A-Za-z\x80-\xff]", t)) for t in tokens]
    out = [plain_hash(t) >> 50 for t in tokens]
    return [0 if letters[i] and tokens[i] in tokens[max(0, i - 2) : i] else r for i, r in enumerate(out)]


def plain_quality(text, table, net):
    """The score of a text: its tokens' vectors added up one by one, then the network unit by unit."""
    own = plain_rows(text)
    x = [sum(int(table[row, d]) for row in own) / quality.UNIT / (len(own) + quality.SHRINK) for d in range(quality.WIDTH)]
    x = [(v - m) / s for v, m, s in zip(x, net.mean, net.spread, strict=True)]
    hidden = [math.tanh(sum(v * w for v, w in zip(x, net.w1[:, h], strict=True)) + net.b1[h]) for h in range(len(net.b1))]
    z = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
    return 1 / (1 + math.exp(-z / net.temperature))


def plain_counts(text):
    m, odd = (1 << 64) - 1, 0x9E3779B97F4A7C15
    found = defaultdict(int)
    points = [ord(c) + 1 for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i : i + n]:
                h = h * odd + p & m
            found[plain_mix(h + (n << 56) & m) >> 64 - language.BITS] += 1
    return found


def plain_language(text, model):
    """Name and score of a text: weighted n-grams at length 1, then a softmax."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = {f: (1 + math.log(c)) * model.idf[f] for f, c in plain_counts(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(v / norm * model.weights[f, c] for f, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(model.names))]
    p = [math.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda c: (z[c], -c))
    return model.names[best], p[best] / sum(p)


def word_sets(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k=4, of=80):
    sets = [word_sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= of * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = root(i)
            least[r] = min(least.get(r, key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        own = least[root(i)] if key is not None else None
        out.append((key, len(sets[i]), own, key is None or own == key))
    return sorted(out, key=repr)


def plain_draw(sizes, target, u):
    """Ids drawn beyond whole copies, and their inclusion probabilities, with plain lists; sizes and u by id."""
    total = sum(sizes.values())
    whole = math.floor(target / total + 1e-12) if total else 0
    rest, drawn, slack = max(target - whole * total, 0.0), [], mixing.SLACK * target

    def fitting():
        below = min(2 * rest, math.floor(rest + slack) + 1)
        return [i for i in sizes if i not in drawn and 0 < sizes[i] < below]

    first, slope = fitting(), None
    for i in sorted(first, key=lambda i: -sizes[i]):
        squares = sum(sizes[j] ** 2 for j in first if sizes[j] <= sizes[i])
        larger = sum(sizes[j] for j in first if sizes[j] > sizes[i])
        if (rest - larger) / squares * sizes[i] <= 1:
            slope = (rest - larger) / squares
            break
    p = {i: 1.0 if slope is None else min(1.0, slope * sizes[i]) for i in sizes}
    rank = {i: 0.0 if p[i] >= 1 else u[i] / (1 - u[i]) / (p[i] / (1 - p[i])) for i in sizes if p[i] > 0}
    while True:
        before, so_far, limit = len(drawn), 0, rest
        for i in sorted(fitting(), key=lambda i: (rank[i], i, sizes[i])):
            so_far += sizes[i]
            over = so_far - limit
            if over <= 0 or (over <= slack and over < sizes[i] - over):
                drawn.append(i)
                rest -= sizes[i]
        if len(drawn) == before:
            break
    left = [i for i in sizes if i not in drawn and 0 < sizes[i] < 2 * rest]
    if rest > slack and left:
        drawn.append(min(left, key=lambda i: (sizes[i], rank[i], i)))
    return whole, set(drawn), {i: p[i] if i in first else 0.0 for i in sizes}


def number(seed, i):
    return (int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= over
