"""Phonetic keys, nicknames and name comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import ladder
from concord.functions.similarity import sequence_ratio
from concord.functions.text import strip

# Letter groups replaced, in this order, before vowels are dropped.
SOUND_GROUPS = (
    ("ph", "f"), ("ck", "k"), ("ght", "t"), ("gh", ""), ("kn", "n"), ("wr", "r"), ("wh", "w"), ("dg", "j"),
    ("tch", "ch"), ("q", "k"), ("x", "ks"), ("z", "s"), ("v", "f"),
)

# First names and the variants that count as the same name.
NICKNAMES = {
    "john": ["jon", "johnny", "jack"],
    "jon": ["john", "johnny"],
    "michael": ["mike", "mikey", "mick"],
    "mike": ["michael"],
    "matthew": ["matt", "mat"],
    "matt": ["matthew"],
    "william": ["bill", "billy", "will", "willy", "liam"],
    "bill": ["william"],
    "robert": ["rob", "bob", "bobby"],
    "bob": ["robert"],
    "richard": ["rich", "rick", "ricky", "dick"],
    "rick": ["richard"],
    "james": ["jim", "jimmy"],
    "jim": ["james"],
    "joseph": ["joe", "joey"],
    "joe": ["joseph"],
    "thomas": ["tom", "tommy"],
    "tom": ["thomas"],
    "daniel": ["dan", "danny"],
    "dan": ["daniel"],
    "anthony": ["tony"],
    "tony": ["anthony"],
    "elizabeth": ["liz", "beth", "lizzy", "eliza"],
    "liz": ["elizabeth"],
    "katherine": ["kate", "kathy", "kat", "katie"],
    "kate": ["katherine"],
    "margaret": ["maggie", "meg", "peggy"],
    "maggie": ["margaret"],
    "patricia": ["pat", "patty", "trish"],
    "pat": ["patricia"],
    "jennifer": ["jen", "jenny"],
    "jen": ["jennifer"],
    "christopher": ["chris"],
    "chris": ["christopher"],
    "steven": ["steve", "stephen"],
    "steve": ["steven", "stephen"],
    "stephen": ["steven", "steve"],
}
NICKNAME_PAIRS = sorted({"|".join(sorted((a, b))) for a, v in NICKNAMES.items() for b in v})


def normalized_name(c: Column) -> Column:
    """Lower-case letters, blanks, hyphens and apostrophes; NULL when nothing is left."""
    v = F.regexp_replace(F.lower(strip(c)), r"(?U)[^a-z\s\-']", "")
    return F.nullif(strip(F.regexp_replace(v, r"(?U)\s+", " ")), F.lit(""))


def phonetic_key(c: Column) -> Column:
    """Up to six letters that sound-alike names share; NULL without letters."""
    v = F.regexp_replace(F.lower(c), "[^a-z]", "")
    v = F.nullif(v, F.lit(""))
    for group, sound in SOUND_GROUPS:
        v = F.replace(v, F.lit(group), F.lit(sound))
    v = F.regexp_replace(v, "(?<=.)[aeiouy]", "")
    return F.substring(F.regexp_replace(v, r"(.)\1+", "$1"), 1, 6)


def is_nickname(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*NICKNAME_PAIRS)


def compare_names(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the comparison of two name columns: score, level, keys, findings and insight."""
    df = df.withColumns({"normalized_a": normalized_name(F.col(a)), "normalized_b": normalized_name(F.col(b))})
    na, nb = F.col("normalized_a"), F.col("normalized_b")
    df = df.withColumns({
        "phonetic_key_a": phonetic_key(na), "phonetic_key_b": phonetic_key(nb),
        "_ratio": sequence_ratio(na, nb), "nickname_match": F.coalesce(is_nickname(na, nb), F.lit(False)),
    })
    missing, same, ratio = na.isNull() | nb.isNull(), na == nb, F.col("_ratio")
    ka, kb = F.col("phonetic_key_a"), F.col("phonetic_key_b")
    alike = F.coalesce((ka == kb) & (ka != ""), F.lit(False))
    one_off = (F.abs(F.length(na) - F.length(nb)) <= 1) & (ratio >= 0.85)
    floor = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0.0))
    best = F.greatest(ratio, floor(F.col("nickname_match"), 0.92), floor(alike, 0.88), floor(one_off, 0.90))
    score = F.when(missing, 0.0).when(same, 1.0).otherwise(F.round(F.least(best, F.lit(1.0)), 4))
    df = df.withColumn("similarity_score", score)
    level = ladder(F.col("similarity_score"), [(0.97, "EXACT"), (0.82, "SIMILAR")], "DIFFERENT")
    notes = F.array_compact(F.array(
        F.when(F.col("nickname_match"), "Known nickname or common name variant detected."),
        F.when(alike, "Names are phonetically similar."),
        F.when(one_off, "Names differ by a minor spelling variation."),
    ))
    df = df.withColumns({
        "match_level": F.when(missing, "UNKNOWN").when(same, "EXACT").otherwise(level),
        "findings": F.when(missing, F.array(F.lit("One or both names are missing.")))
        .when(same, F.array(F.lit("Names match exactly after normalization."))).otherwise(notes),
        "nickname_match": F.when(missing, F.lit(False)).otherwise(F.col("nickname_match")),
    })
    insight = (
        F.when(missing, "Name comparison unavailable.").when(same, "Names match exactly.")
        .when(F.col("match_level") == "EXACT", "Names are effectively identical after normalization.")
        .when(F.col("match_level") == "SIMILAR", "Names appear to be a likely spelling or nickname variation.")
        .otherwise("Names do not strongly support a match.")
    )
    return df.withColumn("insight", insight).drop("_ratio")


def names_by_key(df: DataFrame, column: str) -> DataFrame:
    """How many records and how many spellings share a phonetic key.

    Grouped by spelling first, so a key that half of the records share adds up a few
    spellings and not all its records.
    """
    spelled = df.select(phonetic_key(F.col(column)).alias("phonetic_key"), F.lower(strip(F.col(column))).alias("name"))
    per_name = spelled.where(F.col("phonetic_key").isNotNull()).groupBy("phonetic_key", "name").agg(F.count("*").alias("n"))
    return per_name.groupBy("phonetic_key").agg(
        F.sum("n").alias("records"), F.count("*").alias("spellings"), F.min("name").alias("first_spelling"))
