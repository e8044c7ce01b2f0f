"""Documents with every awkward case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, node int, sig string, kept boolean, bucket int, n int, score double, p0 string"
WORDS = ["the", "of", "and", "tion", "er", "ing", "hath", "ble", "Thore", "nd", "ANEA", "ö", "naïve", "ou,", "x."]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "an", "re", str(rng.randrange(30))]) for _ in range(n))


def rows(seed=0, n=40):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(10, 120)) for _ in range(n)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    base = texts[0].split()
    for k in range(6):  # near copies
        w = list(base)
        w[k * 3 % len(w)] = f"edit{k}"
        out.append((100 + k, " ".join(w), "en", "a", None))
    out += [(200, texts[1], "en", "a", 5), (201, texts[1].upper(), "de", "b", 5), (201, texts[1].upper(), "de", "b", 5)]  # copies, and a repeated row
    out += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \t\n\x0b ", "en", "a", 5), (303, "one", "en", "a", 3), (304, "one two", "en", "a", 7), (305, "One Two", "en", "a", 7)]
    out += [(None, texts[2], "en", "a", 9), (400, sentence(rng, 6000), "en", "a", None), (401, "line\n" * 50, "en", "a", 250), (402, "a b c d e f g h " * 30, "en", "a", 1)]
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, 1, "s", True, 2, 3, 0.5, "p") for r in data], DOC)
