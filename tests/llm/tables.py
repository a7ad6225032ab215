"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row string, hash long, size long, part int, at string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta", "Épsilon", "zeta.", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "", "s", "x1", "q"]) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    plain = [sentence(rng, rng.randint(12, 90)) for _ in range(24)]
    passage = sentence(rng, 60)
    out = [*plain, plain[0], plain[1] + " more", plain[2] + "\n" + passage, passage + "\t" + plain[3], passage]
    out += [None, "", " \n\t ", "one", "Two words", "a b c", "x y z\x0bw", sentence(rng, 6000), "idiot " + plain[4], "same " * 40, "### $$$ | | | " * 9 + plain[5]]
    return out


def documents(spark, rows: list[tuple] | None = None):
    if rows is None:
        rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", "s2", None)[i % 5]) for i, t in enumerate(texts())]
        rows += [rows[0], rows[5]]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", "r", 2, 3, 4, "a") for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
