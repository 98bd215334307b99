"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import types as T

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "sch ung ei lich keit ver be ge zu ä ö ü ß aus nicht pf tz ich ach und".split(),
    "fr": "eau oi é è ê ç que eux aux tion ment ill ou re le ai an on".split(),
}

DOCS = T.StructType([
    T.StructField("score", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns called like the operators' own, and one that differs in case only
    T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("TEXT", T.StringType()), T.StructField("kept", T.BooleanType())])


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))


def sentence(rng, lang, n):
    return " ".join(word(rng, lang) for _ in range(n))


def rows(seed=1, n=60, long_words=6_000):
    """(doc_id, text, lang, source) with copies, near copies, shared passages and awkward rows."""
    rng = random.Random(seed)
    passage = sentence(rng, "en", 20)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append([i, sentence(rng, lang, rng.randint(1, 120)), lang, f"s{i % 7}" if i % 3 else "hot"])
    base = out[0][1] = sentence(rng, "en", 80)
    for i in range(1, 8):                       # near copies and exact copies of document 0
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        out[i][1] = " ".join(words)
        out[i][2] = "en"
    for i in range(10, 30):                     # a passage that many share, at odd places and white space
        out[i][1] = out[i][1] + "\n\t" + passage.replace(" ", "  " if i % 2 else "\n") + " " + sentence(rng, "en", i % 5)
    out[31][1] = out[32][1] = "one two three"
    out[33][1] = (passage + " ") * 3            # a passage inside one document
    for text in (None, "", " \n\t ", "1234 -- !!", "a", "É"):
        out.append([len(out), text, None, None])
    out.append([len(out), sentence(rng, "fr", long_words), "fr", "hot"])
    out.append([len(out), "x" * 20_000, "en", "s1"])
    return out


def frame(spark, data, partitions=4):
    full = [("junk", i, t, lang, source, len(t) if t is not None else None, 7, 7, 1, "other", None) for i, t, lang, source in data]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], DOCS)
