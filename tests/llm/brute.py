"""Plain versions of operators, for small tables."""

import collections
import re

import numpy as np

from maskweave.llm import decontam

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(rows):
    """doc_id, n_shingles, component_id of rows (doc_id, text, ...)."""
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    return [(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True)]


def base_pii(t):
    def luhn(d):
        n = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in n) % 10 == 0

    t = t or ""
    s = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        s += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    s += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(s)


def _tokens(t):
    return [(m.group().translate(LOW), m.start(), m.end()) for m in TOKEN.finditer(t or "")]


def _entity(t, a, k, z):
    return k, t[a:z].lower() if k < 2 else re.sub("[^0-9]", "", t[a:z])


def pii_spans(texts, generalise=0.8, remove=0.95, window=8):
    """(start, kind, end, level) of base spans and terms of each text."""
    n_t, n_e, n_et, contexts, near_of = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set), []
    for t in texts:
        tokens, base = _tokens(t), base_pii(t)
        n_t.update({w for w, _, _ in tokens})
        near = []
        for a, k, z in base:
            left, right = (next((j for j, (_, s, _) in enumerate(tokens) if s >= at), len(tokens)) for at in (a, z))
            around = [j for j in [*range(max(0, left - window), left), *range(right, min(len(tokens), right + window))] if tokens[j][2] - tokens[j][1] >= 3 and not any(tokens[j][1] < q and tokens[j][2] > p for p, _, q in base)]
            near += [(_entity(t, a, k, z), *tokens[j], tuple(tokens[i][0] for i in around)) for j in around]
        n_e.update({_entity(t, a, k, z) for a, k, z in base})
        n_et.update({(e, w) for e, w, *_ in near})
        for e, w, _, _, c in near:
            contexts[e, w].add(c)
        near_of.append(near)
    out = []
    for t, near in zip(texts, near_of, strict=True):
        spans = {(a, k, z, 2) for a, k, z in base_pii(t)}
        level = collections.defaultdict(int)
        for e, w, a, z, _ in near:
            c, ic = len(contexts[e, w]), np.log2(len(texts) / n_e[e])
            ratio = np.log2(len(texts) * n_et[e, w] / (n_e[e] * n_t[w]) * c / (c + 1)) / ic if ic > 0 else 0
            level[a, z] = max(level[a, z], 2 if ratio >= remove else 1 if ratio >= generalise else 0)
        out.append(sorted(spans | {(a, 4, z, v) for (a, z), v in level.items() if v}))
    return out


def rewritten(t, spans):
    """A text with its spans replaced: of overlapping ones the first and longest stands for all."""
    names = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
    at, out = 0, ""
    for a, k, z, level in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            new = names[k] if k < 4 else "" if level == 2 else "<NUMBER>" if t[a:z].isdigit() else "<NAME>" if t[a].isupper() else "<WORD>"
            out += t[at:a] + new
        at = max(at, z)
    return out + t[at:] if spans else t


def contaminated(texts, items):
    """(text, item) to matching tokens, for lists of tokens: an alignment that a mask's window shows, and that verifies."""
    seeds = collections.defaultdict(set)
    for i, item in enumerate(items):
        if len(item) >= decontam.MIN_ITEM:
            for m in decontam.MASKS if len(item) >= decontam.SPAN else ("1" * len(item),):
                for p in range(len(item) - len(m) + 1):
                    seeds[m, tuple(w for w, keep in zip(item[p:], m) if keep == "1")].add((i, p))
    masks, out = {m for m, _ in seeds}, {}
    for d, w in enumerate(texts):
        hits = {(i, at - p) for m in masks for at in range(len(w) - len(m) + 1) for i, p in seeds.get((m, tuple(x for x, keep in zip(w[at:], m) if keep == "1")), ())}
        for i, shift in hits:
            item, best = items[i], (0, 0)
            for a in range(max(0, shift), min(len(w), shift + len(item))):
                score = match = 0
                for b in range(a, min(len(w), shift + len(item))):
                    same = w[b] == item[b - shift]
                    score, match = score + (1 if same else decontam.MISMATCH), match + same
                    best = max(best, (score, -match))  # of equal gain the shorter
            if -best[1] >= min(decontam.MIN_MATCH, len(item)):
                out[d, i] = max(out.get((d, i), 0), -best[1])
    return out


def quality_kept(rows, strict_rate=0.5, reject_rate=0.95):
    """Whether each row (doc_id, text, lang, source, ...) stays."""
    failed, soft, hosts = [], [], collections.defaultdict(list)
    for _, t, _, host, *_ in rows:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n, chars, long = len(w), sum(map(len, w)), max(len(w), 1)
        failed.append(n < 50 or 100 * len(cover) > 50 * n)
        soft.append(4 * len(re.findall(r"[#*$%&|<>]", t or "")) > long or 20 * (len(lines) - len(set(lines))) > long or chars > 15 * long or chars < 2 * long)
        hosts[host].append(failed[-1] or soft[-1])
    rates = [sum(h) / len(h) for h in hosts.values()]
    mean = min(max(np.mean(rates), 1e-4), 1 - 1e-4)
    var = np.var(rates, ddof=1) if len(rates) > 1 else 0.0
    between = max(var - mean * (1 - mean) * np.mean([1 / len(h) for h in hosts.values()]), 1e-5)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
    rate = {k: (sum(h) + mean * weight) / (len(h) + weight) for k, h in hosts.items()}
    verdict = {k: 2 if r >= reject_rate else 1 if r >= strict_rate else 0 for k, r in rate.items()}
    return [not f and verdict[r[3]] < (1 if s else 2) for r, f, s in zip(rows, failed, soft, strict=True)]
