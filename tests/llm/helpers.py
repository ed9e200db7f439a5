"""Small documents with awkward rows, shared by the operators' tests."""

import random

#: Columns whose names operators use within: they must neither be lost in a clash nor read.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, block string, id string, label string, score string, bucket string"


def rows(seed: int = 1, n: int = 60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(150)] + ["Über", "ÇA", "naïve", "naı\u0307ve"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    out = [(i, text(r.randint(1, 80)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), 1) for i in range(n)]
    base = text(200)
    out += [(100, base, "en", "a", 1), (101, base, "en", "b", 1), (102, base.replace(base.split()[50], "changed", 1), "en", "a", 1)]
    out += [(110, None, None, None, None), (111, "", "en", "a", 0), (112, " \n\t ", "en", "a", 3), (113, "one", "en", "a", 3)]
    out += [(114, "x" * 30_000, "en", "a", 1), (115, text(6_000), "de", "b", 1), (116, "tab\tand\x0bvt\x1cno\u00a0break\u2003 end", "en", "c", 1)]
    out += [(3, "same id, other text", "en", "a", 1), (100, base, "en", "a", 1), (None, "no id at all here is some text", "en", "a", 1), (None, base, "en", "a", 1)]
    return [(*x, "clash", "clash", "clash", "clash", "clash", "clash", "clash") for x in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def ascii_words(text):
    return (text or "").encode().lower().split()
