"""Small tables with every odd case: nulls, empty and long texts, ties, repeated
rows, and further columns with clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, fp string, size string, __sk_n_words string"


def sentence(rng, n, words="the of red stone river under light seven quiet maple glass winter north paper engine candle"):
    return " ".join(rng.choice(words.split()) for _ in range(n))


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    out += [out[3], out[3], out[4].replace("stone", "Stone"), None, "", "   \n\t\x0b ", "word", "two words", "Ünïcödé ẞtraße ñandú", "a" * 3000]
    out += [sentence(rng, 20_000), "\n".join([out[5]] * 4 + ["", out[6]]), "line one\r\nline two\nline one\r\nLINE two", "one two three four five " * 30]
    return out


def documents(spark, more=(), seed=1):
    rng = random.Random(seed)
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", "é", None]), None, "x", "y", "z", "w") for k, t in enumerate([*texts(seed), *more])]
    rows += [rows[2], (None, "a text without an id " * 20, None, None, None, None, None, None, None), (7, "another text under the same id", "en", "s2", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
