"""Plain versions of the corpus operators' results, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """Random prose with copies, near copies, long and empty texts, nulls and odd characters."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]

    def prose(k: int) -> str:
        return " ".join(r.choice(vocab) + r.choice(["", "", "", ",", ".\n"]) for _ in range(k))

    base, passage = [prose(r.randint(5, 120)) for _ in range(n // 2)], prose(40)
    texts: list[str | None] = list(base)
    for b in base[: n // 5]:
        texts.append(b)
        w = b.split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    hub = prose(100)
    for _ in range(n // 6):
        w = hub.split(" ")
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [prose(10) + " " + passage + " " + prose(8) for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "one two three four", "ONE two THREE four", "é" * 300, "a" * 5000, "12 34 -- !!", "▁ ▁▁  x", passage, "x y " * 400, "日本語の文章 " * 40]
    r.shuffle(texts)
    return [(i * 3, t, None if t is None or i % 11 == 0 else ("en", "fr")[i % 2], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"spans": F.lit(1), "key": F.lit("k"), "component": F.lit(0), "data": F.lit(b"x"), "rep": F.lit(9)})


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(docs: dict) -> dict:
    sets, parent = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs: list[tuple]) -> dict:
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(docs: list[tuple], items: list[tuple]) -> dict:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m.group())) <= 19 and luhn(_digits(m.group()))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m.group())) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def base_spans(text: str | None, kinds: list) -> tuple[list[int], str]:
    counts, spans = [], []
    for rank, (kind, pattern, ok) in enumerate(kinds):
        found = [m for m in re.finditer(pattern, text or "") if ok(m)]
        counts.append(len(found))
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return counts, ",".join(x[2] for x in sorted(spans))


def secret_parts(text: str) -> list[tuple[int, int, str]]:
    """Every candidate part: start, end, kind."""
    word = r"[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?"
    kinds = {
        "assign": (r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I, lambda m: len(m[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
        "bare_key": (r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])", 0, lambda m: re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])),
        "identifier": (rf"(?<![A-Za-z0-9])(?:user|username|login|account|client_id|access_key_id){word}[A-Za-z0-9._@-]{{3,}}", re.I, bool),
        "endpoint": (r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.I, bool),
    }
    return [(m.start(), m.end(), k) for k, (p, flags, ok) in kinds.items() for m in re.finditer(p, text, flags | re.A) if ok(m)]
