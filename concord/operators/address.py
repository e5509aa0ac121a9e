"""Address parsing, validation and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import ladder
from concord.functions.text import is_blank, strip

# Words written short in a standard address.
SUFFIX_WORDS = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT",
    "PLACE": "PL", "TERRACE": "TER", "PARKWAY": "PKWY", "CIRCLE": "CIR", "APARTMENT": "APT", "SUITE": "STE",
}
DIRECTION_WORDS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
STREET_WORDS = ("ST", "RD", "AVE", "BLVD", "DR", "LN", "CT", "PL", "TER", "PKWY", "CIR")
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]

# Unicode word characters, blanks and digits, as the texts are not only ASCII.
ZIP = r"(?U)\b(\d{5})(?:-\d{4})?\b"
ZIP4 = r"(?U)\b\d{5}-\d{4}\b"
STATE = r"(?U)\b([A-Z]{2})\b"
UNIT = r"(?U)\b(APT|STE|UNIT|#)\s*([A-Z0-9\-]+)\b"
PO_BOX = r"(?U)\bP\s*O\s*BOX\b|\bPO BOX\b"
SPACES = r"(?U)\s+"

PARTS = (
    "raw_address", "standardized_address", "address_line_1", "address_line_2", "city", "state", "postal_code", "country",
    "validation_status", "deliverable_flag", "address_confidence", "findings",
)

INSIGHTS = {
    "EXACT": "Addresses normalize to the same standardized location.",
    "NEAR": "Addresses appear highly similar after normalization and support the match.",
    "PARTIAL": "Addresses share partial similarity but contain differences that may require review.",
    "NONE": "Addresses do not materially support the match after normalization.",
    "UNKNOWN": "Address evidence is incomplete or unavailable.",
}
UNAVAILABLE = "Address comparison unavailable."


def standardized(c: Column) -> Column:
    """Upper case, no stray punctuation, short street and direction words, even commas and blanks."""
    v = F.upper(strip(c))
    v = F.regexp_replace(v, r"(?U)[^\w\s#\-/,]", " ")
    v = strip(F.regexp_replace(v, SPACES, " "))
    for word, short in {**SUFFIX_WORDS, **DIRECTION_WORDS}.items():
        v = F.regexp_replace(v, rf"(?U)\b{word}\b", short)
    v = F.regexp_replace(v, r"(?U)\s*,\s*", ", ")
    return F.btrim(strip(F.regexp_replace(v, SPACES, " ")), F.lit(" ,"))


def _found(v: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(v, pattern, group), F.lit(""))


def validate(df: DataFrame, column: str = "address", prefix: str = "", country: str = "US") -> DataFrame:
    """Adds the parsed parts of ``column``, its validity and what was found, each with ``prefix``."""
    p = lambda name: f"{prefix}{name}"
    missing = is_blank(F.col(column))
    std = F.col(p("standardized_address"))
    df = df.withColumns({
        p("raw_address"): F.when(missing, F.col(column)).otherwise(strip(F.col(column))),
        p("standardized_address"): F.when(~missing, standardized(F.col(column))),
    })
    states = F.filter(F.regexp_extract_all(std, F.lit(STATE), F.lit(1)), lambda s: s.isin(*STATES))
    segments = F.filter(F.transform(F.split(std, ","), strip), lambda s: s != "")
    df = df.withColumns({
        p("postal_code"): _found(std, ZIP),
        p("state"): F.try_element_at(states, F.lit(-1)),
        p("address_line_2"): F.when(
            std.rlike(UNIT), F.concat_ws(" ", F.regexp_extract(std, UNIT, 1), F.regexp_extract(std, UNIT, 2))),
        p("_segments"): segments,
    })
    padded = F.concat(F.lit(" "), std, F.lit(" "))
    street = F.lit(False)
    for word in STREET_WORDS:
        street = street | F.contains(padded, F.lit(f" {word} "))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), F.lit(n)).otherwise(F.lit(0.0))
    zipped, stated = F.col(p("postal_code")).isNotNull(), F.col(p("state")).isNotNull()
    confidence = (
        points(std != "", 0.25) + points(std.rlike(r"(?U)\b\d+\b"), 0.20) + points(street, 0.20)
        + points(stated, 0.15) + points(zipped, 0.20)
    )
    df = df.withColumn(p("address_confidence"), F.round(F.least(confidence, F.lit(1.0)), 2))
    conf = F.col(p("address_confidence"))
    graded = ladder(conf, [(0.85, "VALID"), (0.50, "PARTIAL")], "INVALID")
    notes = F.array_compact(F.array(
        F.when(std != F.upper(F.col(p("raw_address"))), "Address formatting normalized"),
        F.when(zipped & ~std.rlike(ZIP4), "Postal code present without ZIP+4"),
        F.when(std.rlike(PO_BOX), "PO Box detected"),
        F.when((conf >= 0.50) & (conf < 0.85), "Address may be incomplete or partially structured"),
        F.when(conf < 0.50, "Address structure appears insufficient for reliable verification"),
        F.when(~stated, "State missing or not recognized"),
        F.when(~zipped, "Postal code missing"),
    ))
    first, second = (F.get(F.col(p("_segments")), F.lit(i)) for i in (0, 1))
    return df.withColumns({
        p("address_line_1"): F.when(~missing, F.coalesce(first, std)),
        p("city"): second,
        p("country"): F.lit(country),
        p("validation_status"): F.when(missing, "MISSING").otherwise(graded),
        p("deliverable_flag"): F.when(missing | ((conf >= 0.50) & (conf < 0.85)), F.lit(None)).otherwise(conf >= 0.85),
        p("findings"): F.when(missing, F.array(F.lit("Address missing"))).otherwise(notes),
    }).drop(p("_segments"))


def _core(std: Column) -> Column:
    """What is left to compare without ZIP and unit."""
    v = F.regexp_replace(F.regexp_replace(std, ZIP, ""), UNIT, "")
    return strip(F.regexp_replace(v, SPACES, " "))


def compare(df: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Adds ``postal_match_level`` and ``address_match_insight`` for two validated sides."""
    std_a, std_b = F.col(f"{a}standardized_address"), F.col(f"{b}standardized_address")
    df = df.withColumns({"_core_a": _core(std_a), "_core_b": _core(std_b)})
    words = lambda c: F.array_distinct(F.filter(F.split(F.col(c), " "), lambda w: w != ""))
    df = df.withColumns({"_words_a": words("_core_a"), "_words_b": words("_core_b")})
    known = lambda c: F.coalesce(c != "", F.lit(False))
    shared = F.size(F.array_intersect("_words_a", "_words_b"))
    fewest = F.least(F.size("_words_a"), F.size("_words_b"))
    overlap = shared / F.greatest(fewest, F.lit(1))
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    near = same(F.substring(f"{a}postal_code", 1, 5), F.substring(f"{b}postal_code", 1, 5)) & same(
        F.col(f"{a}state"), F.col(f"{b}state"))
    unavailable = ~known(std_a) | ~known(std_b)
    level = (
        F.when(unavailable, "UNKNOWN")
        .when((std_a == std_b) | (F.col("_core_a") == F.col("_core_b")), "EXACT")
        .when(fewest == 0, "UNKNOWN")
        .when(near & (overlap >= 0.75), "NEAR")
        .when(overlap >= 0.50, "PARTIAL")
        .otherwise("NONE")
    )
    insight = F.when(unavailable, UNAVAILABLE)
    for name, text in INSIGHTS.items():
        insight = insight.when(F.col("postal_match_level") == name, text)
    return (
        df.withColumn("postal_match_level", level).withColumn("address_match_insight", insight)
        .drop("_core_a", "_core_b", "_words_a", "_words_b")
    )
