"""Plain Python versions of operators that SQL cannot express, written apart from them."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter
from html import unescape

import numpy as np
import regex
from tidewake.llm import surrogates as S

_ANY = regex.compile(S.ANY)
_FORM = regex.compile(rf"^((?:{S._FORMS})\.?) ")


def _hash(*parts: str) -> str:
    return hashlib.sha512("|".join(parts).encode()).hexdigest()


def _number(*parts: str) -> int:
    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:12], 16)


def _permuted(digits: str, key: str) -> str:
    n, half = len(digits), len(digits) // 2
    a, b = digits[:half], digits[half:]
    for i in range(S.ROUNDS):
        if i % 2 == 0:
            a = str((int(a) + _number(key, str(n), str(i), b)) % 10**half).zfill(half)
        else:
            b = str((int(b) + _number(key, str(n), str(i), a)) % 10 ** (n - half)).zfill(n - half)
    return a + b


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _masked(text: str, stream: str) -> str:
    out = ""
    for i, c in enumerate(text):
        roll = int(stream[i * 2 % 126 :][:3], 16) + i
        out += str(roll % 10) if c in "0123456789" else chr(97 + roll % 26) if "a" <= c <= "z" else chr(65 + roll % 26) if "A" <= c <= "Z" else c
    return out


def surrogate(unit: str, secret: str, attempt: int) -> str:
    kind, value = unit.split("|", 1)
    key = f"{secret}|{attempt}|{kind}"
    syllables = lambda script, n: "".join(S.SYLLABLES[script][_number(key, value, str(i)) % 16] for i in range(1, n + 1))
    if kind == "email":
        host, top = re.match(r"(.*?)(\.[a-z]+)$", value).groups()
        out = _masked("a" * max(0, attempt - S.SHORT_ATTEMPTS) + host, _hash(key, value)) + top
    elif kind == "ip":
        o = [int(x) for x in value.split(".")]
        a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
        for i in range(S.ROUNDS):
            if i % 2 == 0:
                a = (a + _number(key, str(i), str(b))) % 65536
            else:
                b = (b + _number(key, str(i), str(a))) % 65536
        out = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    elif kind in ("ssn", "phone"):
        out = _permuted(value, key)
    elif kind == "card":
        head = value[0] + _permuted(value[1:-1], f"{key}|{value[0]}")
        out = head + str((luhn(value) - luhn(head + "0")) % 10)
    elif kind == "hex":
        whole = _hash(key, value)
        out = "".join(_hash(whole, str(k)) for k in range(len(value) // 128 + 1))[: len(value)]
    elif kind == "key":
        prefix = re.match("AKIA|sk-", value)[0]
        out = prefix + _masked(value[len(prefix) :], _hash(key, value))
    elif kind.startswith("given"):
        _, gender, script = kind.split("-")
        out = S.GIVEN[gender, script][_number(key, value) % 16] + syllables(script, attempt)
    else:
        out = syllables(kind.split("-")[1], 4 + max(0, attempt - S.SHORT_ATTEMPTS)).capitalize()
    return f"{kind}|{out}"


def _kind(e: str) -> str:
    if "@" in e:
        return "email"
    if re.fullmatch(r"[\d.]+", e) and "." in e and len(e.split(".")) == 4:
        return "ip"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", e):
        return "ssn"
    if e.isdigit() and len(e) <= 19:
        return "none" if luhn(e) else "card"
    if len(e) == 19 and re.fullmatch(r"[\d -]+", e) and [len(x) for x in re.split("[ -]", e)] == [4, 4, 4, 4]:
        return "card"
    if e[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", e):
        return "phone"
    return "secret" if re.fullmatch("[0-9a-fA-F]+", e) or e.startswith(("AKIA", "sk-")) else "name"


def _name_units(e: str) -> list[str]:
    form = _FORM.match(e)
    parts = e[form.end() :].split(" ")
    gender = "f" if form[1].rstrip(".") in S.FEMALE_FORMS else "m"
    script = lambda p: "cyrillic" if regex.search(r"\p{Cyrillic}", p) else "latin"
    return [f"given-{gender}-{script(p)}|{p}" for p in parts[:-1]] + [f"family-{script(parts[-1])}|{parts[-1]}"]


def _head(phone: str) -> str:
    m = re.match(r"\+([17]|\d{1,3})", phone)
    return m[0] if m else ""


def _units(e: str, kind: str) -> list[str]:
    if kind == "name":
        return _name_units(e)
    if kind == "none":
        return []
    digits = re.sub(r"\D", "", e[len(_head(e)) :])
    return [{"email": f"email|{e.lower()}", "phone": f"phone|{digits}", "card": f"card|{digits}", "ssn": f"ssn|{digits}"}.get(kind) or (f"{kind}|{e}" if kind != "secret" else f"hex|{e.lower()}" if re.fullmatch("[0-9a-fA-F]+", e) else f"key|{e}")]


def _found(text: str) -> list[tuple[int, int, str, str, list[str]]]:
    """Start, end, entity, kind and units."""
    names = [u for m in _ANY.finditer(text) if _kind(m[0]) == "name" for u in _name_units(m[0])]
    if not names:
        return [(m.start(), m.end(), m[0], k := _kind(m[0]), _units(m[0], k)) for m in _ANY.finditer(text)]
    parts = sorted({u.split("|")[1] for u in names})
    out = []
    for m in regex.compile(f"{S.ANY}|(?<!\\p{{L}})(?:{'|'.join(parts)})(?!\\p{{L}})").finditer(text):
        bare = [u for u in names if u.split("|")[1] == m[0]]
        kind = "name" if bare else _kind(m[0])
        out.append((m.start(), m.end(), m[0], kind, bare[:1] or _units(m[0], kind)))
    return out


def _spelt(e: str, kind: str, new: list[str]) -> str:
    value = [u.split("|", 1)[1] for u in new]
    if kind == "none":
        return e
    if kind == "email":
        shift = len(value[0]) - len(e)
        return "".join(c.upper() if i >= shift and "A" <= e[i - shift] <= "Z" else c for i, c in enumerate(value[0]))
    if kind in ("phone", "ssn", "card"):
        digits, head = iter(value[0]), _head(e) if kind == "phone" else ""
        return head + "".join(next(digits) if c in "0123456789" else c for c in e[len(head) :])
    if kind == "name":
        form = _FORM.match(e)
        return (form[0] if form else "") + " ".join(value)
    return value[0].upper() if kind == "secret" and re.fullmatch("[0-9a-fA-F]*[A-F][0-9a-fA-F]*", e) else value[0]


def replaced(texts: list[str | None], secret: str) -> list[tuple[str | None, int, list[str]]]:
    """New text, number of replaced entities and kinds for each text."""
    found = [_found(t) if t else [] for t in texts]
    real = {u for f in found for x in f for u in x[4]}
    given = {u: surrogate(u, secret, 0) for u in real}
    for attempt in range(1, S.ATTEMPTS + 1):
        first: dict[str, str] = {}
        for u in sorted(given):
            first.setdefault(given[u], u)
        bad = [u for u in given if first[given[u]] != u or given[u] in real]
        if not bad:
            break
        given.update((u, surrogate(u, secret, attempt)) for u in bad)
    out = []
    for t, f in zip(texts, found, strict=True):
        made, at = "", 0
        for a, b, e, kind, units in f:
            made, at = made + t[at:a] + _spelt(e, kind, [given[u] for u in units]), b
        kinds = [x[3] for x in f if x[3] != "none"]
        out.append((None if t is None else made + t[at:], len(kinds), sorted(set(kinds))))
    return out


def article_between_tags(html: str) -> str:
    """The article of a page like those of the given table, by its tags alone."""
    inside = re.search(r"(?s)<article>(.*?)</article>", html)[1]
    lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in lines if x)


def whitening(vectors: list, k: int) -> tuple[int, dict, np.ndarray]:
    """Distinct vectors, deviation by vector, and eigenvalues over their sum, by floats."""
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(x)), object)
    n, sums = len(fit), fit.sum(0)
    values = np.linalg.eigvalsh(np.cov(fit.astype(float).T, bias=True))[::-1]
    return n, {v: int(((n * np.array(v, object) - sums) ** 2).sum()) for v in set(x)}, values[:k] / values.sum()


def spelling_words(docs: list[tuple]) -> Counter:
    """Counts of the words of (doc_id, text)."""
    lower, out = str.maketrans(string.ascii_uppercase, string.ascii_lowercase), Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 5 and n >= 3})


def spelling_variants(counts: Counter) -> set[tuple]:
    """word, form, root, n, n_near, form_n by a look-up of every string one edit away."""
    letters = {c for w in counts for c in w}

    def near(w: str) -> set[str]:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        all_of = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        return (all_of & counts.keys()) - {w}

    found = {w: near(w) for w in counts}
    best = {w: min(x, key=lambda v: (-counts[v], v)) if x else None for w, x in found.items()}
    form = {w: b if b and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(found[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}
