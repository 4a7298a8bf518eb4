"""Fixtures: edge-case rows and a small corpus with copies, near copies and shared passages."""

import random
import re

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma "
         "tau upsilon").split()
SF = "/root/testdata/sf0.001"
#: A column that clashes with names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, pii string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=5, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(140)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = base[r.randrange(4)].split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(60)}"
        a = r.randrange(40)
        rows.append((i, " ".join(w[a:a + 60 + r.randrange(80)])))
    rows += [(200, base[0]), (201, base[0]), (201, base[0]), (None, base[1]), (202, None), (203, None), (204, ""),
             (205, "one two"), (206, "one two"), (207, "a" * 3000), (208, "ab " * 2500), (209, "\n\n \t\n"),
             (210, base[2] + "\n" + base[2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}" if i % 5 else None,
                                   len(t or ""), "r", "k", "p") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
