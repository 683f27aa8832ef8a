"""Small documents for the brute-force tests: copies, near copies, junk, nulls, odd spaces."""

import random

WORDS = "of the and to in that is was for on as with by an erthin ouea ndthe Tion. Öl ñandú été ß x1 #a |b idiot".split(" ")


def texts(seed=0, n=60):
    r = random.Random(seed)
    sent = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(k))
    shared = [sent(40), sent(60), sent(25)]
    out = [None, "", " \t\n", "one", "a b c d e f g h i j k l m n o p", "x" * 5000, "ab " * 2000, "\n".join(["same line of words here"] * 30)]
    for _ in range(n):
        lines = [sent(r.randrange(1, 60)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.4:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        if r.random() < 0.3:
            lines.insert(0, lines[-1])
        out.append(r.choice(["\n", "\n", "\r\n", "\v"]).join(lines))
    for _ in range(n // 3):
        t = r.choice(out[8:])
        if r.random() < 0.5:
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append(t)
    r.shuffle(out)
    return out


def frame(spark, values, **extra):
    rows = [(i * 3 + 1, t, ["en", None][i % 2], [None, "b", "a", "a", "a", "cé"][i % 6], None if t is None else len(t), "x") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
