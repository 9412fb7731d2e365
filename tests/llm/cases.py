"""Small documents with the awkward cases that every operator must handle."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, hash string, gone string, component string, _text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def texts(seed=3):
    """Ids and texts: clean prose, exact and near copies, shared lines, junk, licences, nulls, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]

    def prose(n):
        out = []
        while n > 0:
            k = min(n, r.randint(4, 14))
            out.append(" ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + ".")
            n -= k
        return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))

    docs = [prose(r.randint(30, 220)) for _ in range(40)]
    passage, line = prose(60), "This one line stands in very many documents of the table."
    docs += [docs[0]] * 4 + [docs[1]]
    for i in range(12):  # near copies of each other
        w = docs[2].split(" ")
        w[r.randrange(len(w))] = f"new{i}"
        docs.append(" ".join(w))
    docs += [f"{prose(40)}\n{passage}\n{prose(20)}" for _ in range(5)]
    docs += [f"{line}\n{prose(40)}" for _ in range(8)]
    docs += [f"{prose(25)}\nA line that differs by an edit or tw{c} from others" for c in "oaxyz"]
    docs += ["word " * 60, "", None, "   \n \t ", "one two three", "one two three", "é ü 漢字 𝒳 ﬁ", prose(6000), "a###b " * 50, "#### | |"]
    docs += ["Released under the MIT License.", "x Licensed under CC BY-NC 4.0. y", "gnu general public license " * 3]
    docs += ["<|endoftext|> and <|startoftext|>x don't 123", "LOUD!! " * 40]
    rows = list(enumerate(docs))
    return rows + [(3, docs[3]), (3, docs[3]), (5, prose(50)), (None, docs[4]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)
