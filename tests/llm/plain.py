"""Plain versions of what the pipeline does, in Python loops, to hold its results against."""

import math
import re

from tests.llm.test_scans import plain_base

KINDS = [range(97, 123), range(65, 91), range(48, 58), (32,), (10,), (9, 11, 12, 13), range(128, 192), range(192, 256)]
MARKS = ".,;:!?'\"-_/\\|#$%&*+=<>@~^()[]{}"


def kind_of(byte):
    """0: none of those listed; then the kinds, then the marks."""
    for i, kind in enumerate(KINDS):
        if byte in kind:
            return i + 1
    return len(KINDS) + 1 + MARKS.index(chr(byte)) if chr(byte) in MARKS else 0


def passages(text):
    """The features of each passage of 512 bytes, as lists."""
    data = (text or "").encode()
    width = len(KINDS) + 1 + len(MARKS)
    if not data:
        return [[0.0] * (width + 10)]
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\t-\r ]+", data)]
    out = []
    for low in range(0, len(data), 512):
        part = data[low : low + 512]
        shares = [0.0] * width
        for b in part:
            shares[kind_of(b)] += 1 / len(part)
        own = [i for i, (at, _) in enumerate(words) if low <= at < low + 512]
        n = max(1, len(own))
        lengths = [len(words[i][1]) for i in own]
        mean = sum(lengths) / n
        spread = math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean))
        upper = sum(kind_of(words[i][1][0]) == 2 for i in own) / n
        marked = sum(kind_of(words[i][1][-1]) > len(KINDS) for i in own) / n
        repeats = [sum(i >= lag and words[i][1] == words[i - lag][1] for i in own) / n for lag in range(1, 5)]
        out.append([*shares, mean / 10, spread / 10, n / 100, upper, marked, *repeats, 1.0])
    return out


def score(model, text):
    """The score of a text: encode each passage, weigh by gated attention, add up."""
    p = {k: v.tolist() for k, v in model.p.items()}
    mean, spread = model.mean.tolist(), model.spread.tolist()
    times = lambda x, m: [sum(a * row[j] for a, row in zip(x, m, strict=True)) for j in range(len(m[0]))]
    hidden, weights = [], []
    for features in passages(text):
        x = [max(-5.0, min(5.0, (f - m) / s)) for f, m, s in zip(features, mean, spread, strict=True)]
        h = [math.tanh(a + b) for a, b in zip(times(x, p["W"]), p["b"], strict=True)]
        gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(times(h, p["V"]), times(h, p["U"]), strict=True)]
        hidden.append(h)
        weights.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
    top = max(weights)
    weights = [math.exp(w - top) for w in weights]
    pooled = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(pooled, p["o"], strict=True)) + p["c"][0])))


TOKEN = re.compile(r"[A-Za-z0-9_-]{24,}")
EXAMPLE = re.compile(r"(?i)example|sample|xxxx|0000|1234567|(.)\1{5}")


def masked(rows):
    """rows (doc_id, text, lang, source) -> doc_id: text with its secrets masked."""
    found = {}
    for doc, text, *_ in rows:
        values = []
        for a, kind, b, name in plain_base(text):
            value = text[a:b] if name != "assign" else re.search(r"[A-Za-z0-9+/_.=-]+\Z", text[a:b]).group()
            values.append((a, kind, b, value))
        for m in TOKEN.finditer(text or ""):
            if re.search("[0-9]", m.group()) and re.search("[a-z]", m.group()) and re.search("[A-Z]", m.group()):
                values.append((m.start(), 3, m.end(), m.group()))
        found[doc] = values
    owners, homes = {}, {}
    for doc, _, lang, source in rows:
        for *_, value in found[doc]:
            owners.setdefault(value, set()).add(source)
            homes.setdefault(value, set()).add((source, lang))
    live = lambda v: len(owners[v]) <= 2 and len(homes[v]) <= 4 and not EXAMPLE.search(v)
    out = {}
    for doc, text, *_ in rows:
        base = [x for x in found[doc] if x[1] < 3]
        spans = base + [x for x in found[doc] if x[1] == 3 and live(x[3]) and not any(b[0] < x[2] and b[2] > x[0] for b in base)]
        done, at, mask = "", 0, None
        for a, _, b, value in sorted(spans):
            if a >= at:
                done += (mask or "") + text[at:a]
                mask = "<secret>" if live(value) else "<example>"
            elif live(value):
                mask = "<secret>"
            at = max(at, b)
        out[doc] = done + (mask or "") + text[at:] if spans else text
    return out
