"""Small, awkward corpora."""

import random

WORDS = "river stone lantern harvest copper window garden silver thunder meadow bridge candle forest market signal pocket winter shadow orchard velvet compass island whisper marble engine harbor ribbon castle desert mirror".split()


def prose(rng: random.Random, n: int) -> str:
    """n words in sentences and lines."""
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + str(rng.randrange(50) if rng.random() < 0.3 else "")
        out.append(w.capitalize() + (".\n" if i % 17 == 16 else ". ") if i % 9 == 8 else w + " ")
    return "".join(out).strip()


def corpus() -> list[tuple]:
    """(doc_id, text): nulls, blanks, unicode, control strings, repeats, copies, near copies, shared passages."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([3, 12, 40, 120, 300]))) for i in range(40)]
    passage = prose(rng, 60)
    for i in (3, 9, 21):
        rows[i] = (i, rows[i][1] + " " + passage + " " + prose(rng, 10))
    for i, j in ((30, 5), (31, 5), (32, 11)):
        words = rows[j][1].split(" ")
        words[len(words) // 2] = "altered"
        rows[i] = (i, rows[j][1] if i == 30 else " ".join(words))
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one"), (44, "Ünïcödé Straße — 日本語   x\u0000y 😀 naïve"), (45, "<|endoftext|> a </s>[INST] b <|startoftext|>"), (46, "a b\x0bc\x0cd\r\ne"), (47, "word " * 5000), (48, None), (48, "twice"), (48, "twice")]
    return rows


def make(spark, rows=None):
    """The corpus with columns of clashing names, also of those used inside, over three partitions."""
    df = spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "doc_id AS shard", "text AS kept", "1 AS score", *(f"doc_id AS {x}" for x in "row _row place _place before _before n lost _gone spans _spans source cuts at bucket _bucket size rank h id block".split())).repartition(3)
