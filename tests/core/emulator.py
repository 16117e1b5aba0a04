"""The window join in plain Python, from its rules alone: what the kernels are tested against."""

import math


def z(x):
    m = sum(x) / len(x)
    sd = math.sqrt(sum((v - m) ** 2 for v in x) / len(x))
    return [0.0] * len(x) if sd == 0 else [(v - m) / sd for v in x]


def distance(a, b):
    return math.floor(math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) * 1e5 + 0.5) / 1e5


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def td(ta, va, tb, vb, w, relation, threshold, pin=None):
    first = 0
    if pin is not None:
        if pin < 0 or pin + w > len(va):
            return None
        ta, va, first = ta[pin : pin + w], va[pin : pin + w], pin
    if w <= 2 or w > min(len(va), len(vb)):
        return None
    n_a, n_b, offset = len(va) - w + 1, len(vb) - w + 1, 0
    if relation != "none":
        step, gap = ta[1] - ta[0], ta[0] - tb[0]
        if step == 0 or gap % step:
            return None
        offset = gap // step
    best = None
    for i in range(n_a):
        at = i + offset
        js = {"equal": range(at, at + 1), "meets": range(at + w, at + w + 1), "before": range(at + w, n_b), "overlaps": range(at + 1, at + w - 1), "none": range(n_b)}[relation]
        for j in js:
            if 0 <= j < n_b:
                a, b = z(va[i : i + w]), z(vb[j : j + w])
                if cosine(a, b) >= threshold:
                    key = (distance(a, b), -i, j)
                    best = key if best is None or key < best else best
    return None if best is None else (first - best[1], best[2], best[0])


def stamp(ta, va, tb, vb, w, relation):
    starts, best = {}, None
    for j in range(len(vb) - w + 1):
        starts[tb[j]] = j
    for i in range(len(va) - w + 1):
        for j in range(len(vb) - w + 1):
            sa, ea, sb, eb = ta[i], ta[i + w - 1], tb[j], tb[j + w - 1]
            ok = {"equal": sa == sb and ea == eb and starts[sb] == j, "meets": sb == ea + 1_000_000 and starts[sb] == j, "overlaps": sa < eb and ea > sb and sa != sb, "before": ea < sb, "none": False}[relation]
            if ok:
                key = (distance(z(va[i : i + w]), z(vb[j : j + w])), i if relation in ("equal", "meets") else -i, j)
                best = key if best is None or key < best else best
    return None if best is None else (abs(best[1]), best[2], best[0])
