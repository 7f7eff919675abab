"""Plain-Python versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_scores(rows):
    """doc index -> (held_out, n_tokens, n_known, N, base)."""
    counts = Counter()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*words(low(t)), None] for _, t in rows]
    for h, ts in zip(held, tokens):
        if not h:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for h, ts in zip(held, tokens)]


def remove_repeats(texts, window=35):
    every = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, k=3, seed=42):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows, k=3, radius=2):
    prints = [fingerprint(t, k) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {f: f for f in distinct}

    def find(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[find(f)].append(i)
    return [(i, f"{f:016x}", min(least[find(f)], default=None)) for (i, _), f in zip(rows, prints)]


def quality(text):
    t = text or ""
    w = words(t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = set()
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            twice.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(twice), failed)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """source -> target, by repeated clamping."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in clamped)
        open_w = sum(w[s] for s in names if s not in clamped)
        over = {s for s in names if s not in clamped and w[s] * left / open_w > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else w[s] * left / open_w for s in names}
        clamped |= over


def chat(rows):
    """conv -> (n, turns sha, loss chars, loss sha)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def best_edits(item, text):
    """Least edits of an occurrence of the whole item in the text (full table)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def shingle_set(text, k=5):
    w = words(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def letters_of_bytes():
    """GPT-style byte letters, said once more."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    out, extra = {}, 256
    for b in range(256):
        if b in shown:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def aligned(texts, folder="/opt/tokenizers"):
    """One (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each text, by sets of ends and all pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    letters = letters_of_bytes()
    spelled = {i: bytes(letters[c] for c in t) for t, i in a_model.get_vocab().items() if t != "<|endoftext|>"}
    out, total = [], Counter()
    for t in texts:
        if not t:
            out.append(None)
            continue
        a = a_model.encode(" " + t, add_special_tokens=False).ids
        b = b_model.encode(t)
        a_bytes = [spelled[i] for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            out.append(None)
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(a_bytes), spans(b_bytes)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for c in cuts:
            inside = lambda ids, ss: ",".join(str(i) for i, (s, e) in zip(ids, ss) if low <= s and e <= c)  # noqa: B023, E731
            groups.append(f"{inside(a, sa)}|{inside(b, sb)}")
            low = c
        links = Counter((i, j) for i, (s, e) in zip(a, sa) for j, (u, v) in zip(b, sb) if s < v and u < e)
        total.update(links)
        out.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    empty = (0, 0, 0, 0, 0, 0, "")
    return [empty if o is None else (o[0], o[1], len(o[2]), sum(o[3].values()), sum(n for p, n in o[3].items() if total[p] == best[p[1]]), sum(n * total[p] for p, n in o[3].items()), ";".join(o[2])) for o in out]


def manifest(rows, tampered):
    """One (id, leaf, subroot, root, proof, folded, verified) for each (id, group, values, changed values)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf_of = lambda values: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(level):
        levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            levels.append(level)
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            low = at - at % 8
            yield level[low:at], level[at + 1 : low + 8]
            at //= 8

    groups = defaultdict(list)
    for (i, g, values), other in zip(rows, tampered):
        groups[g].append((i is not None, i or 0, leaf_of(values), i, None if other is None else leaf_of(other)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, leaf, i, other) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*path(trees[g], at), *path(top, k)]
            now = other or leaf
            for left, right in steps:
                now = sha("".join([*left, now, *right]))
            out.append((i, leaf, trees[g][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), now, now == top[-1][0]))
    return out


def exact_copies(rows):
    """One (id, keep, size, kept, sha) for each (id, text)."""
    groups = defaultdict(list)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[bare(t)]
        less, _, _, keep = min(g, key=lambda x: x[:3])
        out.append((i, keep, len(g), i == keep and len(t or "") == -less, hashlib.sha256(bare(t).encode()).hexdigest()))
    return out
