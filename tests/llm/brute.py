"""Brute-force versions of the operators, straight from their definitions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]
ALLOWED = [re.compile(p) for p in (r"^[0-9]+\Z", r"^[A-Za-z/_=+-]+\Z", r"^[a-z0-9/_=-]*[a-z]{12,}[a-z0-9/_=-]*\Z", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z", r"(?i)(example|sample|placeholder|dummy|changeme|xxxxx)")]


def entropy_above(s, bits, width=20):
    for i in range(len(s) - width + 1):
        total = sum(round(c * math.log2(c) * 1e6) for c in Counter(s[i : i + width]).values())
        if total <= math.floor((math.log2(width) - bits) * width * 1e6):
            return True
    return False


def secrets(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    names = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))
    spans = list(base)
    for k, pattern, bits in ((3, r"[0-9a-fA-F]{20,}", 3.0), (4, r"[A-Za-z0-9+/_=-]{20,}", 3.7)):
        new = [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if not any(a.search(m[0]) for a in ALLOWED) and entropy_above(m[0], bits)]
        spans += [x for x in new if not any(s <= x[0] and x[2] <= e for s, _, e in spans)]
    return (*counts, sha(names(base)), names(spans))


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n=4, percent=85):
    """rows: (doc_id, text); returns (doc_id, n_shingles, component_id) by row."""
    sets = [shingles(t, n) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in lists[g] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else least.get(root(i), d)) for i, (d, _) in enumerate(rows)]


def repeated(rows, length=400):
    """rows: (doc_id, text); returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) by row."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(r[i : i + length]).digest() for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hashlib.md5(r[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def passage_words(rows, size=51):
    """rows: (doc_id, text); words within runs of ``size`` words that another row has too."""
    texts = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    own = defaultdict(set)
    for i, w in enumerate(texts):
        for k in range(len(w) - size + 1):
            own[tuple(w[k : k + size])].add(i)
    return [len({x for k in range(len(w) - size + 1) if len(own[tuple(w[k : k + size])]) > 1 for x in range(k, k + size)}) for w in texts]


def tiktoken_encoding(name="byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids))), sha(encoding.decode_bytes(ids))


def token_files(rows, tokenizer, end=2):
    """rows in ascending order; (doc_id, start, n_tokens, ids_crc32)."""
    start, out = 0, []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


NORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=10):
    """n_words, n_hit, n_items, items_sha256, contaminated; items: (item_id, text)."""
    words = NORM.findall((text or "").translate(LOWER))
    at = defaultdict(list)
    hit, found = set(), set()
    grams = {}
    for item, t in items:
        w = NORM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(item)
    for n in {len(g) for g in grams}:
        for k in range(len(words) - n + 1):
            if (g := tuple(words[k : k + n])) in grams:
                hit.update(range(k, k + n))
                found |= grams[g]
    del at
    return len(words), len(hit), len(found), sha(",".join(sorted(str(i) for i in found if i is not None))), bool(hit)


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeat = {i for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for i in (k, k + 1, k + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def quality_verdicts(rows):
    """rows: (key, text, host); (key, kept, host_verdict) by row, from rates of fractions."""
    scored = []
    for key, text, host in rows:
        n, chars, symbols, dup, repeat, base = quality_counts(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        failed = base or symbols * 100 > 10 * chars or dup * 100 > 50 * lines
        scored.append((key, host or "", failed, symbols * 100 > 2 * chars or dup * 100 > 35 * lines or repeat * 100 > 25 * n))
    hosts = defaultdict(list)
    for _, host, failed, _ in scored:
        hosts[host].append(failed)
    total = len(scored)
    m = sum(f for _, _, f, _ in scored) / total
    spread = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / total - m * m - m * (1 - m) * len(hosts) / total
    weight = min(1000.0, max(2.0, m * (1 - m) / spread - 1)) if spread > 0 else 1000.0
    rates = {h: (sum(f) + m * weight) / (len(f) + weight) for h, f in hosts.items()}
    above = lambda h, r: (r - m) / math.sqrt(r * (1 - r) / (len(hosts[h]) + weight + 1)) > 1.6448536269514722 if 0 < r < 1 else r > m
    verdict = {h: "bad" if r > 0.5 else "suspect" if above(h, r) else "good" for h, r in rates.items()}
    return [(key, not (failed or verdict[host] == "bad" or (doubt and verdict[host] == "suspect")), verdict[host]) for key, host, failed, doubt in scored]


def url_verdict(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else default


def fill_in_middle(doc_id, text):
    """n, form, prefix_chars, middle_chars, digests of the output and of the text."""
    text = text or ""
    n, digits = len(text), sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    spm = h4 % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", low, high - low, sha(output), sha(text)


def archive_rows(pages, least=0):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, html); of equal page ids the first row answers."""
    key = lambda x: (x[0] is None, x[0] or 0)
    data = [(p, (h or "").encode(), i) for i, (p, h) in enumerate(pages)]
    first = {}
    for p, d, i in sorted(data, key=lambda x: (key(x), x[2])):
        first.setdefault(d, (p, i))
    out = []
    for p, d, i in data:
        again = len(d) >= least and first[d][1] != i
        out.append((p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if again else "response", first[d][0] if again else None))
    return out


def token_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text), every text encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        groups, data = [], (" " + (text or "")).encode()
        if text:
            sides = [[(i, a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b.encode(text)]]
            if all(b"".join(x for _, x in side) == data for side in sides):
                ends = []
                for side in sides:
                    at, own = 0, []
                    for i, x in side:
                        at += len(x)
                        own.append((at, i))
                    ends.append(own)
                low = 0
                for high in sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}):
                    groups.append(tuple([i for e, i in own if low < e <= high] for own in ends) if len(data) < 3000 else None)
                    low = high
                if groups and groups[0] is None:  # the same by one walk over both sides
                    groups, both, at = [], sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}), [0, 0]
                    for high in both:
                        group = ([], [])
                        for k in (0, 1):
                            while at[k] < len(ends[k]) and ends[k][at[k]][0] <= high:
                                group[k].append(ends[k][at[k]][1])
                                at[k] += 1
                        groups.append(group)
        found.append(groups)
    counts = Counter(pair for groups in found for pair in {(x, y) for ga, gb in groups for x in set(ga) for y in set(gb)})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (d, _), groups in zip(rows, found, strict=True):
        links = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            for x, n in ca.items():
                for y, m in cb.items():
                    links[x, y] += n * m
        names = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((d, sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links.items()), sha(names) if groups else ""))
    return out
