"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from array import array

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_ids(texts, end):
    from tokenizers import Tokenizer

    from vertexloom.llm.common import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [x.ids + [end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc_of(ids):
    return zlib.crc32(array("I", ids).tobytes())


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(rows):
    """{doc_id: component} of [(doc_id, text)]."""
    bits = [(d, fingerprint(t)) for d, t in rows]
    label = {d: d for d, _ in bits if d is not None}
    moved = True
    while moved:
        moved = False
        for a, x in bits:
            for b, y in bits:
                if None not in (a, b) and (x ^ y).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return label


def repeats(rows, length=50):
    """[(doc_id, data, [gone])] of [(doc_id, text)]; a null id is smaller than all others."""
    key = lambda d: -(1 << 63) if d is None else d
    least = {}
    data = [(key(d), (t or "").encode()) for d, t in rows]
    for d, x in data:
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for (d, _), (k, x) in zip(rows, data, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if least[x[i : i + length]] < k:
                gone[i : i + length] = [True] * length
        out.append((d, x, gone))
    return out


def removal(rows, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    out = []
    for d, x, gone in repeats(rows, length):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(text, items, size=13):
    """(n_words, hit word numbers, item ids) of a text."""
    w, hit, found = words(text), set(), set()
    for item, other in items:
        x = words(other)
        for at in range(max(1, len(x) - size + 1) if x else 0):
            window = x[at : at + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    return len(w), hit, found - {None}


def contamination(rows, items):
    out = []
    for d, t in rows:
        n, hit, found = hits(t, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, n, len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= n))
    return out


def cut_hits(text, items):
    """The text without its hit words, and what parts the words of a run."""
    _, hit, _ = hits(text, items)
    spans = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, at, i = [], 0, 0
    while i < len(spans):
        if i in hit:
            j = i
            while j + 1 in hit:
                j += 1
            out.append(text[at : spans[i][0]])
            at, i = spans[j][1], j
        i += 1
    return "".join([*out, text[at:]])


def naive_bayes(rows, text, buckets):
    """(language, score) by a plain multinomial naive Bayes over [(language, text)], n-gram by n-gram."""
    import math

    from vertexloom.llm import langid

    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    langs = sorted({lang for lang, _ in rows})
    counts = {lang: {} for lang in langs}
    for lang, x in rows:
        for f in langid.features(langid.code_points(x), buckets).tolist():
            counts[lang][f] = counts[lang].get(f, 0) + 1
    grams = langid.features(langid.code_points(text), buckets).tolist()
    total, tempered = {}, {}
    for lang in langs:
        prior = math.log((sum(k == lang for k, _ in rows) + 1) / (len(rows) + len(langs)))
        whole = sum(counts[lang].values()) + 0.5 * buckets
        sums = sum(math.log((counts[lang].get(f, 0) + 0.5) / whole) for f in grams)
        total[lang] = sums + prior
        tempered[lang] = sums / max(1, len(grams)) * min(len(grams), langid.EVIDENCE) + prior
    best = max(langs, key=lambda x: total[x])
    top = max(tempered.values())
    return best, math.exp(tempered[best] - top) / sum(math.exp(v - top) for v in tempered.values())
