"""English stems by the published Snowball rules (Porter 2), as column expressions over a vocabulary.

A step finds the longest ending of a word among those it knows and changes it if the ending lies in the region that the
step asks for. Regions: R1 begins after the first consonant that follows a vowel, R2 is the same inside R1. Every step is
a column of its own, so no expression is worked out twice. A corpus has far fewer words than occurrences: stems are made
for distinct words and joined back. Words are lower case; null stays null, words of two letters or fewer stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
DOUBLE = r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
# Fixed values of the published rules: words with stems of their own, words that stay after the first step, beginnings that R1 follows.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = "gener|commun|arsen"
# Fixed values of the published rules: endings and what takes their place, for the second and third step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def ending(word: Column, endings) -> Column:
    """The longest of some endings that a word has, else the empty string."""
    return F.regexp_extract(word, f"({'|'.join(endings)})$", 1)


def cut(word: Column, end: Column) -> Column:
    return F.left(word, F.length(word) - F.length(end))


def after(word: Column, start: Column, pattern: str) -> Column:
    """Where a region begins: behind the first match of a pattern from start on, else at the word's end."""
    found = F.regexp_extract(F.substring(word, start + 1, F.length(word)), pattern, 0)
    return F.when(found != "", start + F.length(found)).otherwise(F.length(word))


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """words, distinct or not, with their stem."""
    w, p1, p2, e = F.col("_w"), F.col("_p1"), F.col("_p2"), F.col("_e")
    in1, in2 = F.length(cut(w, e)) >= p1, F.length(cut(w, e)) >= p2
    before = cut(w, e)

    def step(rows: DataFrame, endings, changed: Column) -> DataFrame:
        """The word with its longest ending changed; words that are done, or lack all of the endings, stay."""
        rows = rows.withColumn("_e", ending(w, endings))
        return rows.withColumn("_w", F.when((e != "") & ~F.col("_done"), changed).otherwise(w))

    rows = words.withColumn("_w", F.regexp_replace(F.col(word), "^'", ""))
    rows = rows.withColumn("_w", F.regexp_replace(w, rf"^y|(?<={VOWEL})y", "Y"))
    rows = rows.withColumn("_p1", F.when(w.rlike(f"^(?:{BEGINNINGS})"), F.length(F.regexp_extract(w, f"^(?:{BEGINNINGS})", 0))).otherwise(
        after(w, F.lit(0), f"^.*?{VOWEL}{OTHER}")))
    rows = rows.withColumn("_p2", after(w, p1, f"^.*?{VOWEL}{OTHER}")).withColumn("_done", F.lit(False))
    rows = step(rows, ("'s'", "'s", "'"), before)
    one = F.when(e == "sses", F.concat(before, F.lit("ss"))).when(e.isin("ied", "ies"), F.concat(before, F.when(F.length(before) > 1, "i").otherwise("ie")))
    rows = step(rows, ("sses", "ied", "ies", "us", "ss", "s"), one.when((e == "s") & before.rlike(f"{VOWEL}.*.$"), before).otherwise(w))
    rows = rows.withColumn("_done", w.isin(*KEPT))
    bare = F.when(e.isin("eed", "eedly"), F.when(in1, F.concat(before, F.lit("ee"))).otherwise(w))
    rows = rows.withColumn("_was", w)
    rows = step(rows, ("eed", "eedly", "ed", "edly", "ing", "ingly"), bare.when(before.rlike(VOWEL), before).otherwise(w))
    shortened = (w != F.col("_was")) & ~e.isin("eed", "eedly")
    is_short = w.rlike(SHORT_END) & (p1 >= F.length(w))
    mended = F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE), F.left(w, F.length(w) - 1)).when(is_short, F.concat(w, F.lit("e"))).otherwise(w)
    rows = rows.withColumn("_w", F.when(shortened, mended).otherwise(w))
    rows = rows.withColumn("_w", F.when(~F.col("_done"), F.regexp_replace(w, rf"(?<=.{OTHER})[yY]$", "i")).otherwise(w))

    def replaced(table: dict[str, str]) -> Column:
        to = F.coalesce(*(F.when(e == a, b) for a, b in table.items()))
        return F.concat(before, to)

    fits = in1 & ((e != "ogi") | before.rlike("l$")) & ((e != "li") | before.rlike("[cdeghkmnrt]$"))
    rows = step(rows, SECOND, F.when(fits, replaced(SECOND)).otherwise(w))
    rows = step(rows, THIRD, F.when(in1 & ((e != "ative") | in2), replaced(THIRD)).otherwise(w))
    rows = step(rows, FOURTH, F.when(in2 & ((e != "ion") | before.rlike("[st]$")), before).otherwise(w))
    last = F.when((e == "e") & (in2 | (in1 & ~before.rlike(SHORT_END))), before).when((e == "l") & in2 & before.rlike("l$"), before)
    rows = step(rows, ("e", "l"), last.otherwise(w))
    own = F.coalesce(*(F.when(F.col(word) == a, b) for a, b in SPECIAL.items()))
    stem = F.when(F.length(word) <= 2, F.col(word)).otherwise(F.coalesce(own, F.lower(w)))
    return rows.select(*words.columns, stem.alias("stem"))


def stemmed(rows: DataFrame, word: str = "word") -> DataFrame:
    """rows with the stem of their word, made once for each distinct word."""
    known = stems(rows.select(F.col(word).alias("_word")).distinct(), "_word")
    return rows.join(known, F.col(word) == F.col("_word"), "left").drop("_word")


def sentence_stems(rows: DataFrame, key: str, text: str, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """key, stem, n: how often words of a stem stand in the sentences of a text; short words and stopwords don't count."""
    words = rows.select(key, F.explode(F.flatten(T.sentence_tokens(text))).alias("word"))
    counted = words.where(~F.col("word").isin(*stopwords)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return stemmed(counted).groupBy(key, "stem").agg(F.sum("n").alias("n"))
