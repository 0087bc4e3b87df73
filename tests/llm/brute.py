"""Plain Python versions of the corpus operators."""

import math
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return SPACE.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text, True)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(docs, k, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, k))
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    links = []
    for n, (i, a) in enumerate(flat):
        for j, b in flat[n + 1 :]:
            if i != j and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    return components(sets, links)


def spans_removed_by_row(docs, window):
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def spans_removed(docs, window):
    return {i: tuple(rest) for i, *rest in spans_removed_by_row(docs, window)}


def backoff(docs, order, alpha, least):
    counts = [Counter() for _ in range(order + 1)]
    for _, t in docs:
        w = words(t)
        for n in range(1, order + 1):
            counts[n].update(tuple(w[p : p + n]) for p in range(len(w) - n + 1))
    total = sum(counts[1].values())
    out = []
    for i, t in docs:
        w = words(t)
        score = 0
        for p in range(len(w)):
            cost = 0.0
            for n in range(min(order, p + 1), 0, -1):
                g = tuple(w[p - n + 1 : p + 1])
                if n == 1:
                    score += round(1e6 * (cost + math.log(counts[1][g] / total)))
                elif counts[n][g] >= least:
                    score += round(1e6 * (cost + math.log(counts[n][g] / counts[n - 1][g[:-1]])))
                    break
                else:
                    cost += math.log(alpha)
        out.append((i, len(w), score))
    return out


def lines_removed(docs, width):
    wins = []
    for i, t in docs:
        if i is None or t is None:
            continue
        solid = [(n, x.strip(" ")) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
        for p in range(len(solid) - width + 1):
            wins.append((i, solid[p][0], solid[p + width - 1][0] + 1, tuple(x for _, x in solid[p : p + width])))
    seen, gone = set(), {}
    for i, a, b, g in sorted(wins, key=lambda x: x[:2]):
        if g in seen:
            gone.setdefault(i, set()).update(range(a, b))
        seen.add(g)
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, t in docs]


def leaks(docs, items, k, percent):
    sets = {j: shingles(t, k) for j, t in items if j is not None}
    out = []
    for i, t in docs:
        w = words(t, True)
        grams = {n: {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} for n in range(1, k + 1)}
        for j, s in sets.items():
            own = grams[len(next(iter(s)))] if s else set()
            if i is not None and s and 100 * len(s & own) >= percent * len(s):
                out.append((i, j, len(s), len(s & own)))
    return sorted(out)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [sum(divmod(2 * c, 10)) for c in d[1::2]]) % 10 == 0


def base_spans(text):
    """(start, rank, stop, kind) of the confirmed matches."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def personal(text):
    return joined(base_spans(text))


def _contexts(text, start, stop):
    """Patterns of a match: what stands before and after it, up to the neighbouring words."""
    spans = [m.span() for m in SPACE.finditer(text)]
    first = next(i for i, (a, b) in enumerate(spans) if a <= start < b)
    last = next(i for i, (a, b) in enumerate(spans) if a < stop <= b)
    left = text[spans[first][0] : start] or (text[slice(*spans[first - 1])] if first else "")
    right = text[stop : spans[last][1]] or (text[slice(*spans[last + 1])] if last + 1 < len(spans) else "")
    if not left:
        return []
    left, right = left.lower(), right.lower()
    return [f"L {left}"] + ([f"B {left} {right}"] if right else [])


def extracted(texts, trust, support):
    """Base spans and those of unseen identifiers in the contexts of trusted patterns, for each text."""
    kinds = list(PATTERNS)
    bases = [base_spans(t) for t in texts]
    edges, seeds, found = set(), set(), []
    for t, base in zip(texts, bases, strict=True):
        for a, _, b, kind in base:
            seeds.add((t[a:b], kind))
            edges |= {(p, t[a:b]) for p in _contexts(t, a, b)}
        own = []
        for m in SPACE.finditer(t or ""):
            if re.search("[0-9]", m[0]):
                core = re.sub(r"^[\W_]+|[\W_]+$", "", m[0])
                start = m.start() + m[0].index(core)
                if all(b <= start or a >= start + len(core) for a, _, b, _ in base):
                    patterns = _contexts(t, *m.span())
                    own.append((start, start + len(core), patterns))
                    edges |= {(p, core) for p in patterns}
        found.append(own)
    values_of = {}
    for p, v in edges:
        values_of.setdefault(p, set()).add(v)
    scores, before = dict.fromkeys(seeds, 1.0), None
    while True:
        patterns = {}
        for p, values in values_of.items():
            for kind in kinds:
                known = [scores[v, kind] for v in values if (v, kind) in scores]
                score = round(sum(known) / len(values), 9)
                if len(known) >= support and score >= trust:
                    patterns[p, kind] = score
        now = len(patterns), sum(patterns.values())
        if before and now[0] == before[0] and now[1] - before[1] <= 1e-6:
            break
        before, scores = now, dict.fromkeys(seeds, 1.0)
        for kind in kinds:
            wrong = {}
            for p, v in edges:
                if (p, kind) in patterns and (v, kind) not in seeds:
                    wrong[v] = wrong.get(v, 1.0) * max(1 - patterns[p, kind], 1e-9)
            scores |= {(v, kind): round(1 - w, 9) for v, w in wrong.items() if round(1 - w, 9) >= trust}
    out = []
    for base, own in zip(bases, found, strict=True):
        spans = list(base)
        for a, b, ps in own:
            told = [(patterns[p, kind], -rank) for p in ps for rank, kind in enumerate(kinds) if (p, kind) in patterns]
            if told:
                rank = -max(told)[1]
                spans.append((a, rank, b, kinds[rank]))
        out.append(joined(spans))
    return out


def alignment(docs, first, second):
    """{row: digests} of (doc_id, text) rows: whole texts encoded at once, links found byte by byte."""
    import hashlib

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    letters = sorted(ByteLevel.alphabet())
    printable = {c: ord(c) for c in letters if ord(c) < 256}
    rest = iter(sorted(set(range(256)) - set(printable.values())))
    letter = printable | {c: next(rest) for c in letters if c not in printable}
    spans, counts, top = [], {}, {}
    for _, text in docs:
        whole = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        spelled_x = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
        spelled_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y]
        if not text or b"".join(spelled_x) != whole or b"".join(spelled_y) != whole:
            x = y = spelled_x = spelled_y = []
        owner_x = [i for i, s in enumerate(spelled_x) for _ in s]
        owner_y = [i for i, s in enumerate(spelled_y) for _ in s]
        links = sorted(set(zip(owner_x, owner_y, strict=True)))
        borders = lambda o: {i + 1 for i in range(len(o)) if i + 1 == len(o) or o[i] != o[i + 1]}
        groups, start = [], 0
        for stop in sorted(borders(owner_x) & borders(owner_y)):
            side = [",".join(str(ids[i]) for i in sorted(set(o[start:stop]))) for ids, o in ((x, owner_x), (y, owner_y))]
            groups.append("|".join(side))
            start = stop
        spans.append((x, y, links, groups))
        for i, j in links:
            counts[x[i], y[j]] = counts.get((x[i], y[j]), 0) + 1
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for (doc_id, _), (x, y, links, groups) in zip(docs, spans, strict=True):
        found = [(counts[x[i], y[j]], top[y[j]]) for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(n == m for n, m in found), sum(n for n, _ in found), digest))
    return out
