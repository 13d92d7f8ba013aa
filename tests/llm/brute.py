"""Brute-force versions of what the operators give, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import pairwise

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return SPACE.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spans(text: str | None, kinds: list[tuple]) -> str:
    """Digest of (kind, pattern, test of match) spans."""
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern, valid) in enumerate(kinds)
        for m in re.finditer(pattern, text or "")
        if valid(m)
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(m: re.Match) -> str:
    return re.sub("[^0-9]", "", m[0])


SECRETS = [
    (
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, t = words(text), text or ""
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """n_words, n_hit, sorted item ids as text."""
    w, hit, found = item_words(text), set(), set()
    for item, t in items:
        own = item_words(t)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeats(rows: list[tuple], length: int = 13) -> list[tuple]:
    """(n_words, n_removed, kept text) of (doc_id, text) rows, in their order."""
    first: dict[tuple, float] = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            run = tuple(w[k : k + length])
            first[run] = min(first.get(run, math.inf), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {
            j
            for k in range(len(w) - length + 1)
            if first[tuple(w[k : k + length])] < key(i)
            for j in range(k, k + length)
        }
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shingles(text: str | None, width: int) -> set[tuple]:
    w = words((text or "").translate(LETTERS))
    if not w:
        return set()
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows: list[tuple], width: int, percent: int) -> dict:
    """doc_id to component for rows without null ids."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_gram = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            by_gram[g].append(at)
    for at, (i, s) in enumerate(sets):
        shared = Counter(o for g in s for o in by_gram[g] if o < at)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def mixing(rows: list[tuple], weights=(1, 2, 3), most: int = 3) -> dict:
    """source to (size, target) of (source, size) rows, resharing step by step."""
    size = defaultdict(int)
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > most * size[s]}
        if not over:
            target.update({s: weight[s] * share for s in open_})
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
        open_ -= over
    return {s: (size[s], target[s]) for s in order}


def unigram(train: list[str | None], text: str | None) -> tuple:
    """n_tokens, n_known, N, base score."""
    tokens = lambda t: [*words((t or "").translate(LETTERS)), None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    own = tokens(text)
    score = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
    return len(own), sum(c[w] > 0 for w in own), n, score


def ppm(train: list[bytes], text: bytes, order: int = 3) -> float:
    """log10 probability by a trie of dictionaries: method C with exclusion."""
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for t in train:
        whole = b"\0" * order + t
        for i in range(order, len(whole) + 1):
            symbol = whole[i] if i < len(whole) else 256
            for k in range(order + 1):
                counts[whole[i - k : i]][symbol] += 1

    def distribution(context: bytes) -> list[float]:
        lower = distribution(context[1:]) if context else [1.0] * 257
        own = counts.get(context)
        if not own:
            total = sum(lower)
            return [x / total for x in lower]
        total, kinds = sum(own.values()), len(own)
        rest = sum(x for s, x in enumerate(lower) if s not in own)
        out = [
            own[s] / (total + kinds) if s in own else (kinds / (total + kinds) * x / rest if rest else 0.0)
            for s, x in enumerate(lower)
        ]
        total = sum(out)
        return [x / total for x in out]

    whole = b"\0" * order + text
    score = 0.0
    for i in range(order, len(whole) + 1):
        symbol = whole[i] if i < len(whole) else 256
        score += math.log10(distribution(whole[i - order : i])[symbol])
    return score


def merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches joined."""
    edges = sorted({j for a, b in spans_ for j in range(a, b)})
    out: list[list[int]] = []
    for x, y in pairwise([None, *edges]):
        if x is None or y != x + 1:
            out.append([y, y + 1])
        else:
            out[-1][1] = y + 1
    return [tuple(x) for x in out]


# ---- the pipeline's stages, and scores of many texts at once


def cut(text: str, items: list[tuple]) -> str:
    """Text without its words inside any item's window."""
    w, hit = item_words(text), set()
    for _, t in items:
        own = item_words(t)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        hit.update(j for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n))
    at = iter(range(len(w)))
    return re.sub(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lambda m: "" if next(at) in hit else m[0], text)


def mod97(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


#: Score and context words of PII, then the kinds beside them.
CARD_WORDS = "card|visa|credit|payment"
REDACTED = [
    (*PII[0], 0.9, "mail|contact|write"),
    (*PII[1], 0.6, "ip|host|server|address"),
    (*PII[2], 0.8, CARD_WORDS),
    (*PII[3], 0.6, "phone|call|tel|mobile"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?!\w)", lambda m: mod97(m[0]), 0.8, "iban|account|bank"),
    ("card_run", r"(?<!\w)[0-9]{14,19}(?!\w)", lambda m: luhn(m[0]), 0.7, CARD_WORDS),
    ("phone_nanp", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?!\w)", lambda m: True, 0.6, "phone|call|tel"),
    ("ssn", r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)", lambda m: True, 0.3, "ssn|social|security"),
]


def redacted(text: str) -> str:
    found = []
    for rank, (kind, pattern, valid, score, near) in enumerate(REDACTED):
        for m in re.finditer(pattern, text, re.ASCII):
            around = text[max(0, m.start() - 60) : m.start()] + " " + text[m.end() : m.end() + 60]
            if valid(m) and score + 0.35 * bool(re.search(rf"(?ai)(?<!\w)({near})", around)) >= 0.5:
                found.append((m.start(), rank, m.end(), kind))
    out, at = "", 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out += f"{text[at:start]}[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def mixed(rows: list[tuple], key: dict) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of (doc_id, source, size) rows;
    ``key`` orders a source's last pass."""
    want, out = mixing([x[1:] for x in rows]), []
    for s, (size, target) in want.items():
        budget = math.floor(target + 0.5)
        times = budget // size if size else 0
        rest = budget - times * size
        for i, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: (key[x[0]], x[0], x[2])):
            last = max(0, min(n, rest))
            rest -= last
            out.append((i, n, size, target, times * n + last))
    return sorted(out)


def unigram_all(train: list[str], texts: list[str]) -> list[tuple]:
    """What ``unigram`` gives of each text."""
    tokens = lambda t: [*words((t or "").translate(LETTERS)), None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    log = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(len(own), sum(c[w] > 0 for w in own), n, sum(map(log, own))) for own in map(tokens, texts)]


def ppm_all(train: list[bytes], texts: list[bytes], order: int = 3) -> list[float]:
    """What ``ppm`` gives of each text; a context's distribution is kept."""
    counts: dict[bytes, Counter] = defaultdict(Counter)
    grams = lambda t: [(w[i - order : i], w[i] if i < len(w) else 256) for w in [b"\0" * order + t] for i in range(order, len(w) + 1)]
    for context, symbol in (x for t in train for x in grams(t)):
        for k in range(order + 1):
            counts[context[order - k :]][symbol] += 1
    kept: dict[bytes, list[float]] = {}

    def distribution(context: bytes) -> list[float]:
        if context not in kept:
            lower = distribution(context[1:]) if context else [1.0] * 257
            own = counts.get(context, {})
            total, kinds = sum(own.values()), len(own)
            rest = sum(x for s, x in enumerate(lower) if s not in own)
            escape = kinds / (total + kinds) if own else 1.0
            out = [own[s] / (total + kinds) if s in own else escape * x / rest for s, x in enumerate(lower)]
            total = sum(out)
            kept[context] = [x / total for x in out]
        return kept[context]

    return [sum(math.log10(distribution(c)[s]) for c, s in grams(t)) for t in texts]
