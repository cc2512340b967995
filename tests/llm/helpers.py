from __future__ import annotations

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long, n string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


def corpus(seed: int = 1, n: int = 60):
    """Documents with copies, near copies, shared passages and edge cases."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = prose(rng, 40)
    for i in range(0, n, 7):
        texts[i] = prose(rng, 20) + " " + passage + "\n" + prose(rng, 15)
    for i in range(3, n, 9):
        texts[i] = texts[2]
    for i in range(4, n, 8):
        w = texts[1].split() + prose(rng, 60).split()[:2] if i % 16 else prose(random.Random(9), 90).split()
        w[i % len(w)] = f"odd{i}"
        texts[i] = " ".join(w)
    texts += [None, "", "  \n ", "one", "ONE", "two words", passage, "x" * 5000, prose(rng, 6000), "é ñ ü z 　 wide", "a <|im_end|> b"]
    return [(i, t, "en", "s", None, "clash") for i, t in enumerate(texts)]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
