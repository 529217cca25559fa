"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

#: Texts that a table may hold: null, empty, blank, one word, repeated, very long, other scripts.
ODD_TEXTS = [None, "", "   \n\t", "word", "word", "a b", "a b", "ÀÉ ñ ü ß 日本語 😀 text", "x " * 30_000, "y" * 50_000, "1234567890", "!!! ??? ...", "1" * 60_000, "1" * 5_000 + ".1.1.1 and " + "0" * 5_000 + "1.2.3.4", " " * 60_000, "-" * 60_000, "[ " * 30_000, "password=" + "as" * 30_000, "token: " + "é" * 9 + "0123456789abcdef" * 2]


def fold(text):
    return (text or "").encode().lower()


def lm_base(docs):
    """doc_id -> (held out, tokens, known, N, base score)."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in docs if not held(i) for w in [*fold(t).split(), None])
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, t in docs for ws in [[*fold(t).split(), None]]}


def lm_score(ids, p, starts, symbols, context=32, stride=16):
    """log10 probability of a text's ids and its end, symbol by symbol and sum by sum."""
    end = len(symbols.of) - 1
    seen = [int(symbols.of[i]) for i in [end, *ids]]
    nexts = [*ids, end]
    vec = lambda name, s: [float(x) for x in p[name][s]]
    times = lambda v, m: [sum(v[i] * float(m[i][j]) for i in range(len(v))) for j in range(len(m[0]))]
    cache = {s: tuple(times(vec("E", s), p[w]) for w in ("Q", "K", "V", "A", "B")) for s in set(seen)}
    total = 0.0
    for at, following in enumerate(nexts):
        window = 0 if at < context else -(-(at + 1 - context) // stride)
        begin = window * stride
        q = cache[seen[at]][0]
        weights = [math.exp(sum(a * b for a, b in zip(q, cache[seen[j]][1], strict=True)) / math.sqrt(len(q)) + float(p["R"][at - j])) for j in range(begin, at + 1)]
        mixed = [sum(w * cache[seen[j]][2][i] for w, j in zip(weights, range(begin, at + 1), strict=True)) / sum(weights) for i in range(len(cache[seen[at]][2]))]
        before = cache[seen[at - 1]][4] if at > begin else [0.0] * len(p["b"])
        h = [math.tanh(a + b + c + float(d)) for a, b, c, d in zip(cache[seen[at]][3], before, times(mixed, p["D"]), p["b"], strict=True)]
        symbol = int(symbols.of[following])
        group = max(i for i in range(len(starts) - 1) if starts[i] <= symbol)
        z = [a + float(b) for a, b in zip(times(h, p["G"]), p["g"], strict=True)]
        total += z[group] - math.log(sum(map(math.exp, z)))
        x, y = int(starts[group]), int(starts[group + 1])
        z = [sum(h[i] * float(p["O"][i][j]) for i in range(len(h))) + float(p["o"][j]) for j in range(x, y)]
        total += z[symbol - x] - math.log(sum(map(math.exp, z)))
        if symbol == symbols.other:
            total += float(symbols.share[following])
    return total / math.log(10)


def fingerprint(text):
    words = fold(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """(id, fingerprint) rows -> id -> least id that can be reached."""
    prints = [(i, f) for i, f in prints if i is not None]
    out = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if (f ^ g).bit_count() <= 3 and out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


def overlap(docs, items, window=10):
    """(words, hit words, items) of each document."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for text in docs:
        ws, hit, met = split(text), set(), set()
        for name, item in items:
            iw = split(item)
            n = min(window, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == iw[k : k + n]:
                        hit |= set(range(i, i + n))
                        met.add(str(name))
        out.append((len(ws), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def longest_overlap(text, items):
    """Words of the longest run that text shares with an item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    ws, best = split(text), 0
    for item in items:
        before = [0] * (len(ws) + 1)
        for w in split(item):
            before = [0] + [before[i] + 1 if w == v else 0 for i, v in enumerate(ws)]
            best = max(best, *before)
    return best


def pii_base(text):
    text = text or ""
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(re.fullmatch("0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])", x) for x in m[0].split("."))]

    def luhn(s):
        ds = [int(c) for c in s][::-1]
        return (sum(ds[::2]) + sum(sum(divmod(2 * x, 10)) for x in ds[1::2])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return shown(found, ("email", "ip", "card", "phone"))


def secret_base(text):
    text = text or ""
    found = [(*m.span(), "assign") for m in re.finditer(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6 and m[0].isascii()]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return shown(found, ("assign", "access", "hex"))


def span_cost(v, rank, near):
    """log10 of the guesses for a whole value as one span."""
    low, size = v.lower(), lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100
    costs = [sum(math.log10(size(c)) for c in v)]
    if low in rank:
        costs.append(math.log10(rank[low] * (1 if v == low else 2) + 1))
    year, month, day = "(19|20)[0-9][0-9]", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
    for form, many in ((year, 120), (f"{year}[-/.]?{month}", 1440), (f"{year}[-/.]?{month}[-/.]?{day}", 43800), (f"{day}[-/.]?{month}[-/.]?{year}", 43800)):
        if re.fullmatch(form, v):
            costs.append(math.log10(many))
    for n in (1, 2, 3, 4):
        if len(v) >= 3 * n and low == low[:n] * (len(v) // n):
            costs.append(sum(math.log10(size(c)) for c in low[:n]) + math.log10(len(v) // n))
    if len(v) >= 4 and all(b in near.get(a, ()) for a, b in zip(low, low[1:], strict=False)):
        costs.append(math.log10(141 * len(v)))
    return min(costs)


def guess_cost(v, rank, near):
    """The least cost of all cuts of a value."""
    best, cost = math.inf, {(i, j): span_cost(v[i:j], rank, near) for j in range(len(v) + 1) for i in range(j)}
    for cuts in range(2 ** (len(v) - 1)):
        ends = [i + 1 for i in range(len(v) - 1) if cuts >> i & 1] + [len(v)]
        best = min(best, sum(cost[p] for p in zip([0, *ends], ends, strict=False)) + math.log10(5) * (len(ends) - 1))
    return best


def shown(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], kinds.index(s[2]))))


def nearest(rows, k=5):
    """(query, rank, id, score) for the queries among (id, vector) rows."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q % 50 == 0:
            scores = sorted(((float(x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y), -j) for j, y in good if j != q and len(y) == len(x)), reverse=True)
            out += [(q, r + 1, -j, s) for r, (s, j) in enumerate(scores[:k])]
    return out


def quality_score(raw, model):
    """The model's score of a text, passage by passage and number by number."""
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    passages = [raw[i : i + 400] for i in range(0, len(raw), 400)] or [b""]
    rows = []
    for part in passages:
        share = [0] * (7 + len(signs))
        for b in part:
            c = chr(b)
            kind = 6 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c == "\n" else 7 + signs.index(c) if c in signs else 5
            share[kind] += 1
        size, ws = max(1, len(part)), part.split()
        row = [math.sqrt(n / size) for n in share]
        if ws:
            m, same = len(ws), lambda k: sum(a == b for a, b in zip(ws, ws[k:], strict=False)) / len(ws)  # noqa: B023
            row += [len(set(ws)) / m, same(1), same(2), same(3), min(m / 100, 1), min((size - m) / m / 10, 2), max(map(len, ws)) / 40, 1 / m]
        else:
            row += [0.0] * 8
        rows.append(row)
    return 1 / (1 + math.exp(-quality_logit(rows, model)[0]))


def quality_logit(rows, model):
    """(logit, encodings, tanh parts, gates, attention, pooled encoding, scaled rows) of a bag."""
    p, n = model.p, len(model.p["b"])
    g = len(p["w"])
    scaled = [[(float(x) - m) / s for x, m, s in zip(row, model.mean, model.scale, strict=True)] for row in rows]
    h = [[max(0.0, sum(x * p["W"][i][j] for i, x in enumerate(row)) + p["b"][j]) for j in range(n)] for row in scaled]
    t = [[math.tanh(sum(e[j] * p["V"][j][k] for j in range(n))) for k in range(g)] for e in h]
    u = [[1 / (1 + math.exp(-sum(e[j] * p["U"][j][k] for j in range(n)))) for k in range(g)] for e in h]
    raw = [sum(a * b * w for a, b, w in zip(x, y, p["w"], strict=True)) for x, y in zip(t, u, strict=True)]
    weights = [math.exp(a - max(raw)) for a in raw]
    a = [x / sum(weights) for x in weights]
    z = [sum(x * e[j] for x, e in zip(a, h, strict=True)) for j in range(n)]
    return sum(x * c for x, c in zip(z, p["c"], strict=True)) + p["d"][0], h, t, u, a, z, scaled


def quality_fit(model, bags, labels, epochs, size, rate=0.01, decay=1e-4, seed=5):
    """Adam on gradients by small differences of the mean loss."""
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(0), every.std(0) + 0.02
    rng, m, v, t = np.random.default_rng(seed), {}, {}, 0

    def loss(part):
        total = 0.0
        for k in part:
            p = 1 / (1 + math.exp(-quality_logit(bags[k].tolist(), model)[0]))
            total -= math.log(p if labels[k] else 1 - p)
        return total / len(part)

    for epoch in range(epochs):
        step = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        order = rng.permutation(len(bags))
        for i in range(0, len(order), size):
            part, grads = order[i : i + size], {}
            for name, values in model.p.items():
                grads[name] = np.zeros_like(values)
                for at in np.ndindex(values.shape):
                    kept, sides = values[at], []
                    for d in (1e-5, -1e-5):
                        values[at] = kept + d
                        sides.append(loss(part))
                    values[at] = kept
                    grads[name][at] = (sides[0] - sides[1]) / 2e-5
            t += 1
            for name, grad in grads.items():
                grad = grad + decay * model.p[name]
                m[name] = 0.9 * m.get(name, 0) + 0.1 * grad
                v[name] = 0.999 * v.get(name, 0) + 0.001 * grad * grad
                model.p[name] = model.p[name] - step * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)


def gram_counts(text, buckets):
    """Bucket -> count of the character n-grams of a text, gram by gram."""
    chars = [ord(c) for c in " " + text.lower() + " "]
    chars = [c if 97 <= c <= 122 or c >= 0xAA else 32 for c in chars]
    out, mask = {}, 2**32 - 1
    for n in (1, 2, 3):
        for end in range(n - 1, len(chars)):
            mixed = n
            for back in range(n - 1, -1, -1):
                mixed = mixed * 0x01000193 & mask ^ chars[end - back] * 0x9E3779B1 & mask
            cell = (((mixed ^ mixed >> 15) * 0x2C1B3C6D & mask) >> 7) % buckets
            out[cell] = out.get(cell, 0.0) + 1.0
    return out


def ftrl(rows, n, classes, alpha, beta, l1, l2):
    """Weights after learning (places, values, label) rows one by one, number by number."""
    z, s = [[0.0] * classes for _ in range(n)], [[0.0] * classes for _ in range(n)]

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(s[i][k])) / alpha + l2)

    for at, values, label in rows:
        logits = [sum(x * weight(i, k) for i, x in zip(at, values, strict=True)) for k in range(classes)]
        e = [math.exp(x - max(logits)) for x in logits]
        for i, x in zip(at, values, strict=True):
            for k in range(classes):
                w, g = weight(i, k), x * (e[k] / sum(e) - (k == label))
                sigma = (math.sqrt(s[i][k] + g * g) - math.sqrt(s[i][k])) / alpha
                z[i][k] += g - sigma * w
                s[i][k] += g * g
    return [[weight(i, k) for k in range(classes)] for i in range(n)]


def language(text, model):
    """The probability of each language."""
    x = {i: math.log1p(n) * float(model.idf[i]) for i, n in gram_counts(text, len(model.idf)).items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    logits = [sum(v / length * float(model.weights[i][k]) for i, v in x.items()) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(z - max(logits)) for z in logits]
    return [a / sum(e) for a in e]
