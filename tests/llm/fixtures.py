"""A small table that holds what the operators must bear: nulls, empty and long texts, ties, repeated rows, copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, node long, tiff_error string"


def words(rng: random.Random, n: int, size: int = 300) -> list[str]:
    return ["".join(rng.choice(["ba", "re", "mi", "to", "lu", "sä", "ne"]) for _ in range(1 + rng.randrange(size) % 4)) for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = " ".join(words(rng, 60))
    texts: list[str | None] = [None, "", " ", "\n\n\n", "short", "a" * 700, "ab" * 400, "x\n" * 40, "one two three\n" * 9]
    for _ in range(40):
        w = words(rng, rng.randrange(5, 260))
        for i in range(9, len(w), 10):
            w[i] += "\n" + w[i]
        texts.append(" ".join(w))
    for _ in range(8):
        texts.append(" ".join(words(rng, 30)) + " " + shared + "\n" + " ".join(words(rng, 20)))
    base = " ".join(words(rng, 200)).split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[12], texts[12], texts[15], " ".join(words(rng, 6000)), "Straße idiot 漢字   x <|endoftext|> y z \x1c q"]
    out = [(i * 3, t, None if i % 7 == 0 else ["en", "fr"][i % 2], [None, "s1", "s2", "s3", "s1"][i % 5], 0, "clash", 1, "clash") for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], out[5], (None, texts[14], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (30, "another text of an id that repeats " * 6, "en", "s1", 0, "c", 2, "c")]
