"""Small tables with every awkward case, and words as the contracts define them."""
import random
import re

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, t string"


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def shingles(text, width):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def prose(seed, n=60, vocabulary=4000):
    r = random.Random(seed)
    w = [f"w{r.randrange(vocabulary)}" if r.random() < .7 else r.choice(["the", "of", "And", "été", "straße"]) for _ in range(n)]
    return "".join(x + (".\n" if i % 13 == 12 else " ") for i, x in enumerate(w)).strip()


def edited(text, at):
    w = text.split(" ")
    w[at % len(w)] = f"edit{at}"
    return " ".join(w)


def rows():
    """Copies, near copies, nulls, empty, blank and one-word texts, repeated rows, a null id and a long text."""
    a, b, c = prose(1, 120), prose(2, 80), prose(3, 200)
    passage = prose(99, 70)
    texts = [a, b, c, a, edited(a, 50), edited(edited(a, 50), 70), None, "", "   \n\t ", "word", "two words", "Two\twords", prose(4, 3000), a + "\n" + passage, passage + "\n" + b,
             b.upper(), "x" * 500, "ab" * 300 + " " + "ab" * 200, prose(5) + "\n" + prose(5), c]
    out = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None, "hot"][i % 3], len(t or ""), 0.5, "k", "t") for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, prose(7), "en", "hot", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


def edge(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
