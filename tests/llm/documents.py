"""Small document tables with the awkward cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, host string, fp long, license string"

ALPHABETS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éèêàçùîô"}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 7))) for _ in range(n))


def rows(seed: int = 3, n: int = 80) -> list[tuple]:
    """Documents with copies, near copies, ties, nulls, empty and long texts, and clashing columns."""
    rng, out = random.Random(seed), []
    for k in range(n):
        lang = rng.choice(sorted(ALPHABETS))
        text = "\n".join(sentence(rng, lang, rng.randint(20, 60)) for _ in range(rng.randint(1, 5)))
        if k % 7 == 1:
            text, lang = out[-1][1], out[-1][2]
        elif k % 7 == 2:
            words, lang = (out[-2][1] or "x").split(" "), out[-2][2]
            text = " ".join(words[:-1] + ["changed"])
        elif k % 11 == 5:
            text = text + "\nthis line is everywhere on the host"
        source = None if k % 13 == 4 else f"s{k % 3}"
        out.append((k, text, lang, source))
    out += [(n, None, "aa", "s0"), (n + 1, "", None, "s1"), (n + 2, " \n\t ", "bb", None), (n + 3, "123 $$$ 456", "bb", "s1")]
    out += [(n + 4, sentence(rng, "aa", 9000), "aa", "s0"), (None, sentence(rng, "bb", 70), "bb", "s2"), (3, out[3][1], out[3][2], out[3][3])]
    return [(*r, None if r[1] is None else len(r[1]), 1, "h", 2, "none") for r in out]


def table(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
