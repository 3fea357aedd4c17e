"""Small fixtures shared by the tests of this folder."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, d long, k long, n_dropped string, ids string, tag int, h long"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, texts, columns=COLUMNS, lang="en", source="s"):
    """Rows of ``documents`` with extra columns whose names clash with internal ones. ``texts``: (doc_id, text) pairs."""
    rows = [(i, t, lang if (i or 0) % 7 else None, source if (i or 0) % 5 else None, len(t) if t else None, 1, "x", 2, 3, "z", "q", 4, None) for i, t in texts]
    return spark.createDataFrame(rows, columns)


def odd_texts():
    """Nulls, empty and blank texts, one long text, ties and repeated rows, a null and a repeated id."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta", "theta", "漢字", "x1", "<|endoftext|>", "it's"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_text = say(20_000)
    same = say(120)
    return [(0, None), (1, ""), (2, " \n\t "), (3, long_text), (4, same), (5, same), (5, same), (6, same + " end"), (7, say(60)),
            (None, same), (None, None), (8, "one"), (9, "one"), (10, "a\nb\n\na\nb"), (7, say(61)), (11, "!!!"), (12, "12 34")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
