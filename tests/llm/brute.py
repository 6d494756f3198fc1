"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def quality_base(text):
    t = text or ""
    ws = words(t)
    seen, twice = {}, set()
    for i in range(len(ws) - 7):
        key = tuple(ws[i:i + 8])
        if key in seen:
            twice |= {seen[key], i}
        else:
            seen[key] = i
    covered = {j for i in twice for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)),
            "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(ws) < 20 or 100 * len(covered) > 30 * len(ws)}


def norm_line(line):
    return " ".join(words(re.sub("[0-9]", "0", line.lower())))


def quality(rows, least, share, remain):
    """rows: (doc_id, text, host); kept per row."""
    per, hosts = {}, {}
    for _, text, host in rows:
        hosts[host] = hosts.get(host, 0) + 1
        for x in {norm_line(x) for x in (text or "").split("\n") if words(x)}:
            per[host, x] = per.get((host, x), 0) + 1
    out = []
    for doc_id, text, host in rows:
        b = quality_base(text)
        gone = sum(len(words(x)) for x in (text or "").split("\n") if words(x)
                   and per[host, norm_line(x)] > least
                   and per[host, norm_line(x)] > share * hosts[host])
        b["removed_words"] = gone
        b["kept"] = not b["base_failed"] and b["n_words"] - gone >= remain * b["n_words"]
        out.append({"doc_id": doc_id, **b})
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19
     and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source -> target words."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, out = {}, {}
    total = share * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        room = total - sum(full.values())
        out = {s: room * w[s] / sum(w[x] for x in left) for s in left} if left else {}
        over = [s for s in left if out[s] >= most * sizes[s]]
        if not over:
            return {**full, **out}
        full |= {s: most * sizes[s] for s in over}


def fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    ws = words(low)
    if not ws:
        return 0
    k = min(shingle, len(ws))
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i:i + k]).encode(), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows, max_bits=4):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}."""
    prints = {i: fingerprint(t) for i, t in rows}
    return components(prints, max_bits)


def components(prints, max_bits=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def exact_groups(rows):
    """(doc_id, text) rows as stored -> (doc_id, keep_id, size, kept, sha) of each."""
    plain = [re.sub("[\\x20\\x09-\\x0D]", "", t or "") for _, t in rows]
    members = {}
    for i, p in enumerate(plain):
        members.setdefault(p, []).append(i)
    first = {p: min(m, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
             for p, m in members.items()}
    return [(d, rows[first[p]][0], len(members[p]), first[p] == i, sha256(p.encode()))
            for i, ((d, _), p) in enumerate(zip(rows, plain))]


def hard_negatives(rows, every=100, positives=5, negatives=5, low=80, high=100):
    """(id, vector, label) rows -> mined rows."""
    fine = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k in rows
            if i is not None and k is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, k in fine:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m == k) for j, w, m in fine
                        if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            near = [(n, t) for t, n, same in scored if not same and -low * s <= -high * t <= -high * s]
            out += [(i, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(near[:negatives])]
    return out


def alignment(rows, a_path, b_path):
    """(doc_id, text) rows -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_lib, b_lib = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}

    def a_bytes(i):
        return bytes(byte[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def spans(ids, of):
        ends = [sum(len(of(i)) for i in ids[:n + 1]) for n in range(len(ids))] if len(ids) < 50 else None
        if ends is None:
            ends, at = [], 0
            for i in ids:
                at += len(of(i))
                ends.append(at)
        return list(zip([0, *ends], ends))
    made, total = [], {}
    for d, t in rows:
        a, b = (a_lib.encode(" " + (t or ""), add_special_tokens=False).ids, b_lib.encode(t or ""))
        raw = (" " + (t or "")).encode()
        if not t or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            made.append((d, [], [], [], ""))
            continue
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        linked, j = [], 0
        for x, (s, e) in zip(a, sa):
            while sb[j][1] <= s:
                j += 1
            n = j
            while n < len(sb) and sb[n][0] < e:
                linked.append((x, b[n]))
                n += 1
        for p in linked:
            total[p] = total.get(p, 0) + 1
        groups, i, j = [], 0, 0
        for e in sorted({e for _, e in sa} & {e for _, e in sb}):
            x, y = i, j
            while i < len(sa) and sa[i][1] <= e:
                i += 1
            while j < len(sb) and sb[j][1] <= e:
                j += 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        made.append((d, a, b, linked, ";".join(groups)))
    top = {}
    for (_, y), n in total.items():
        top[y] = max(top.get(y, 0), n)
    return [(d, len(a), len(b), len(g.split(";")) if g else 0, len(p), sum(total[x] == top[x[1]] for x in p),
             sum(total[x] for x in p), sha256(g.encode()) if g else "") for d, a, b, p, g in made]
