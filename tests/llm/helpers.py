"""Small inputs with every awkward case, and plain versions of the operators."""
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, key string, "
          "component_id long, word string, score double, bucket int, id long")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward_texts():
    """doc_id -> text: nulls, blanks, short, unicode, long, equal and near copies, repeated passages."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (120, 90, 60, 200)]
    near = base[0].split(" ")
    near[5] = "changed"
    passage = prose(rng, 50, 10**6)
    long_text = " ".join(prose(rng, 400, 10**6) for _ in range(60))
    texts = [None, "", "   \t\n ", "one", "one two", "ONE two", base[0], base[0], " ".join(near), base[1], base[2], base[3],
             base[1] + " " + passage, passage + "\n" + base[2], passage, "spam " * 80, "é ü ß 日本 " * 12,
             "x" * 5000, long_text, "a b", "!!! ??? 123", base[3].upper(), long_text + " tail"]
    return dict(enumerate(texts))


def frame(spark, texts=None, extra=()):
    """A documents table with extra columns whose names an operator might use itself."""
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "ü"][i % 4], len(t or ""), -1, "k", -2, "w", 0.5, 3, -3)
            for i, t in (awkward_texts() if texts is None else texts).items()]
    return spark.createDataFrame(rows + [tuple(r) + (-1, "k", -2, "w", 0.5, 3, -3) for r in extra], SCHEMA)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
