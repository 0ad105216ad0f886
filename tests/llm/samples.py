"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, block string, code int, k string, score string"
WORDS = ["alpha", "Beta", "gamma", "delta", "ÉPSILON", "zeta", "eta", "θήτα", "iota", "kappa", "lambda", "mu", "nu", "xi", "9", "pi"]
BREAKS = [" ", "  ", "\n", "\t", "\x0b", "\u00a0 ", ", "]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice(BREAKS) for _ in range(n))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    shared = [prose(rng, 40) for _ in range(3)]
    out: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "\u00a0\x00!"), (7, prose(rng, 30_000))]
    for i in range(10, 60):
        out.append((i, prose(rng, rng.randrange(1, 60)) + rng.choice(["", *shared]) + prose(rng, rng.randrange(0, 30))))
    out += [(60 + i, out[10 + i][1]) for i in range(8)]  # copies
    out += [(70, out[20][1] + " more"), (None, shared[0]), (None, None), out[12], out[12]]  # near copy, null ids, repeated rows
    rng.shuffle(out)
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ["en", "fr", None][k % 3], ["a", "b", None, "c", "d"][k * k % 5], None if t is None else len(t), "x", 1, "y", "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS)


def same(left, right) -> bool:
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    a, b = order(left), order(right)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y
    return True
