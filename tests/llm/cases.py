"""Small documents with everything awkward in them."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, size int, key string, id string, mark int, y string, target string"


def documents(spark, seed=0, rows=60):
    """Nulls in any column, empty and long texts, copies, near copies, shared passages, and columns with clashing names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for k in range(rows):
        text = " ".join(word() for _ in range(rng.randint(0, 120)))
        kind = k % 12
        if kind == 1 and out:
            text = out[k // 2][1]
        elif kind == 2:
            text = f"{text}\t{passage}\n{word()}"
        elif kind == 3:
            text = None
        elif kind == 4:
            text = ""
        elif kind == 5:
            text = "  \t\n "
        elif kind == 6:
            text = f"Ünïcödé {text} 中文 😀 <|endoftext|> \x1c mail a.b{k}@example.com, call +1 (555) 123-4567"
        elif kind == 7:
            text = "same words " * 3
        elif kind == 8 and out:
            base = (out[k // 3][1] or "x").split() or ["x"]
            text = " ".join([*base, "extra"])
        elif kind == 9:
            text = " ".join([word()] * 400) + " " + "q" * 3000
        out.append((k if k != 11 else None, text, "en", rng.choice(["s1", "s2", "hot", "hot", None]), len(text or ""), 1, 2, "k", "i", 3, "y", "t"))
    out += [out[2], out[2], (2, "another text under a repeated id", None, "hot", None, None, None, None, None, None, None, None)]
    return out, spark.createDataFrame(out, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
