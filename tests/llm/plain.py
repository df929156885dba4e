"""Plain versions of what the operators compute."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    n = min(n, len(w)) or 1
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def find_links(sets, percent=80):
    ids = sorted(sets)
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return [(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if near(sets[i], sets[j])]


def groups(nodes, links):
    label = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """kind, start, end of the base kinds by the plain patterns."""
    out = []
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = [
        ("email", email, lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    for kind, pattern, valid in checks:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(m.group())]
    return out
