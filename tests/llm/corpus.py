"""Small corpora with every odd case, and the contracts written out plainly."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, start string, ids string, sequence_id string"
SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def rows(seed=1, n=40):
    """Documents (doc_id, text): null and empty texts, null ids, repeated rows, exact and near copies, shared lines and passages, long texts, many scripts, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñßRST") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(k))

    passage, line = prose(80), "  A Shared Line of some length \t"
    out = [(i, prose(rng.randint(1, 160))) for i in range(n)]
    out += [(100 + i, out[i][1]) for i in range(4)]  # exact copies
    out += [(110 + i, out[20 + i][1].replace("a", "b", 1)) for i in range(4)]  # near copies
    out += [(120 + i, prose(20) + "\n" + line + "\n" + passage + " " + prose(15)) for i in range(5)]
    out += [(130, None), (131, ""), (132, "   \n \t"), (133, "日本語 Σίσυφος ΣΑΣ İstanbul é x​y <|endoftext|> a  b   c\n \nd"), (134, "ab " * 900), (135, "x" * 700), (136, "no break sep"), (137, "123 456 !!!"), (138, "<|startoftext|><|endoftext|>")]
    out += [(140, prose(6000)), (None, "a text without an id, which is long enough"), (None, out[3][1]), (None, None)]
    out += [out[5], out[5], (141, "tie tie tie\ntie tie tie"), (142, "tie tie tie\ntie tie tie")]
    return out


def frame(spark, pairs, langs=None):
    langs = langs or {}
    data = [(d, t, langs.get(d), f"src{(d or 0) % 3}" if d != 7 else None, len(t or ""), "clash", "clash", "clash", "clash", "clash") for d, t in pairs]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def same(a, b):
    """Equal as bags of rows."""
    return sorted(map(repr, a)) == sorted(map(repr, b))
