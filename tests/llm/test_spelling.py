import random
import re
import zlib
from collections import Counter

from amortia.llm import spelling

from .helpers import documents, odd_texts


def counts(texts):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts):
    n = counts(texts)
    form, k = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        k[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], k[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(spark, texts):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(spark, texts)).collect()), key=repr)


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["colour", "aaaaa", "aaaaaa", "aabaa", "éclair", "Straße", "naïve", "Theory", "theories", "bbbbbb", "ÀÀÀÀÀ", "p×q÷rs"]
    letters = "abcé×"

    def edited(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return w if kind == 0 else w[:i] + rng.choice(letters) + w[i:] if kind == 1 else w[:i] + w[i + 1:] if kind == 2 else w[:i] + rng.choice(letters) + w[i + 1:]

    texts = [(i, " ".join(edited(edited(rng.choice(words[:1 + i % 12]))) for _ in range(60))) for i in range(250)]
    texts += odd_texts() + [(300, "colour, COLOUR! colour-colour 1colour2"), (None, "colour colour")]
    got = found(spark, texts)
    assert got == brute(texts)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_runs_of_one_letter_count_once(spark):
    texts = [(1, "aaaaa " * 20 + "aaaaaa " * 8 + "aaaaaaa " * 3)]
    assert found(spark, texts) == brute(texts) == [("aaaaa", None, "aaaaa", 20, 1, None), ("aaaaaa", "aaaaa", "aaaaa", 8, 2, 20),
                                                   ("aaaaaaa", "aaaaaa", "aaaaa", 3, 1, 8)]


def test_a_long_chain_has_one_root(spark):
    words = ["a" * 5 + "bcdefghijkl"[:i] for i in range(9)]
    texts = [(None, " ".join(" ".join([w] * (3 << (8 - i))) for i, w in enumerate(words)))]
    got = found(spark, texts)
    assert got == brute(texts) and {r[2] for r in got} == {words[0]}


def test_empty_inputs(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, ""), (3, "abc")]) == []
