"""Plain, slow versions of the text operators, and awkward rows to try them on."""

import random
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACE_WORD.findall((text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(a, b, num, den):
    both = len(a & b)
    return bool(a and b) and den * both >= num * (len(a) + len(b) - both)


def components(texts, size, num, den):
    """doc_id -> smallest linked doc_id, over all pairs."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    label = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] != label[b] and similar(sets[a], sets[b], num, den):
                    low = min(label[a], label[b])
                    label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
                    changed = True
    return label


def statistics(text):
    w = SPACE_WORD.findall(text or "")
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward(seed=1):
    """Rows with nulls, empty and white texts, copies, near copies, repeats, symbols and one long text."""
    texts = [None, "", " \t\n", "one", "one", "One", "a b c", "a b c d e f g h i j " * 3, "é 日本 x y z", "x | # * <b> & 5%\nx\n\nx"]
    for k in range(12):
        base = prose(k, 40 + 12 * k)
        w = base.split(" ")
        texts += [base, base.upper(), " ".join([*w[:5], "changed", *w[6:]]), " ".join(w[: len(w) * 9 // 10]), base + "\n" + base]
    texts.append(prose(99, 20_000))
    return [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}" if i % 7 else None, None) for i, t in enumerate(texts)]
