"""Candidate pairs out of a source table: blocks, refined by the fields without which a score cannot reach the threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import col_or_null, comparable_email, compact, email_trust, folded
from concord.operators.address import ZIP, standardized
from concord.operators.names import phonetic_key
from concord.operators.scoring import SCORE_WEIGHTS, score_pairs
from concord.operators.signals import Sides, compared_texts, entity_id, source_trust
from concord.sources.tables import stored

# A refined block with more records than this is split over salts, one for each so many records.
HOT_BLOCK = 1_000_000
# Review threshold of the seeded policies.
LEAST = 0.70
# Rounding of signals and scores never lifts a score by more.
ROUNDING = 0.005

# Signals that are 1 where two fields say the same and 0 otherwise.
EXACT_SIGNALS = ("member_id", "supplier_id", "tax_id", "provider_id", "npi", "gtin", "lot_date", "dob")
# What lifts a score beyond its sum: an addition, or a floor (at most so high) for pairs that agree in one of the signals.
BOOSTS = {"PROVIDER": 0.15}
FLOORS = {"CUSTOMER": (0.82, ("dob",)), "SUPPLIER": (0.98, ("supplier_id", "tax_id")), "PATIENT": (0.92, ("dob",))}
# Most that a patient pair gets.
PATIENT_MOST = 0.92


@dataclass(frozen=True)
class ColumnMapping:
    """Which columns of the source table hold what; unmapped fields take no part."""

    primary_key: str
    identifier: str | None = None
    first_name: str | None = None
    last_name: str | None = None
    name: str | None = None
    email: str | None = None
    address: str | None = None
    dob: str | None = None
    source_system: str | None = None
    additional: tuple[str, ...] = field(default=())

    def roles(self) -> dict[str, str]:
        """Names of the mapped fields by what this mapping calls them."""
        named = {"identifier": "member_id", "first_name": "first_name", "last_name": "last_name", "name": "first_name", "email": "email",
                 "address": "address", "dob": "dob", "source_system": "source_system"}
        return {k: v for k, v in named.items() if getattr(self, k)}

    def fields(self) -> dict[str, str]:
        named = {"member_id": self.identifier, "first_name": self.first_name or self.name, "last_name": self.last_name,
                 "email": self.email, "address": self.address, "dob": self.dob, "source_system": self.source_system}
        return {k: v for k, v in named.items() if v} | {c: c for c in self.additional}


def _blocks(records: DataFrame, m: ColumnMapping) -> Column:
    """Blocking keys of a record: identifier, mailbox, and sound of the name with ZIP."""
    keys = []
    tagged = lambda kind, text: F.when(text != "", F.struct(F.lit(kind).alias("kind"), text.alias("key")))
    if m.identifier:
        keys.append(tagged("identifier", folded(F.col(m.identifier))))
    if m.email:
        keys.append(tagged("email", comparable_email(F.col(m.email))))
    name = m.last_name or m.name
    if name and m.address:
        zip5 = F.substring(F.regexp_extract(standardized(F.col(m.address)), ZIP, 1), 1, 5)
        sound = phonetic_key(F.col(name))
        keys.append(F.when((zip5 != "") & (sound != ""), F.struct(
            F.lit("name_zip").alias("kind"), F.concat_ws("|", sound, zip5).alias("key"))))
    return F.array_compact(F.array(*keys))


def needed(domain: str, least: float) -> list[str] | None:
    """Exact signals of which a pair must share one to score ``least``; None where it need not share any.

    If a pair differs in all of them, it loses their weights together. The heaviest are taken until that loss is more
    than the score can spare, so few fields are enough; a floor needs its own signals among them.
    """
    out: set[str] = set()
    for name in ("PROVIDER", "OTHER") if domain == "PROVIDER" else (domain if domain in SCORE_WEIGHTS else "OTHER",):
        weights = SCORE_WEIGHTS[name]
        spare = sum(weights.values()) + BOOSTS.get(name, 0.0) - (least - ROUNDING)
        top, floored = FLOORS.get(name, (0.0, ()))
        chosen = [s for s in floored if least - ROUNDING <= top]
        for signal in sorted(set(EXACT_SIGNALS) & set(weights), key=lambda s: (-weights[s], s)):
            if sum(weights[s] for s in chosen) <= spare and signal not in chosen:
                chosen.append(signal)
        if sum(weights[s] for s in chosen) <= spare:
            return None
        out |= set(chosen)
    return sorted(out)


def _agreeing(f: Sides, domain: Column, signal: str) -> Column:
    """What one record brings to an exact signal; empty when it says nothing."""
    fields = {"supplier_id": ("supplier_id", "member_id"), "lot_date": ("effective_lot_date",)}.get(signal, (signal,))
    if signal == "member_id":
        return folded(entity_id(f, "a", domain))
    if signal == "dob":
        return F.when(domain == "PATIENT", folded(f.either("a", "patient_dob", "dob"))).otherwise(folded(f("a", "dob")))
    return folded(f.either("a", *fields))


def _winkler_bound(a: Column, b: Column) -> Column:
    """Highest Jaro-Winkler similarity of two texts of these lengths."""
    x, y = F.length(a), F.length(b)
    jaro = (F.lit(2.0) + F.least(x, y) / F.greatest(x, y)) / 3.0
    return F.when((x == 0) | (y == 0), 0.0).when(a == b, 1.0).otherwise(jaro + (F.lit(1.0) - jaro) * 0.4)


def _profile(f: Sides, domain: str) -> Column:
    """What the bound needs of one record, worked out once before it meets others."""
    named = F.lit(domain)
    texts = compared_texts(f, named, F.lit(False), "a")
    mail = compact(comparable_email(texts["email"]))
    return F.struct(
        *[_agreeing(f, named, s).alias(s) for s in EXACT_SIGNALS], folded(f("a", "human_id")).alias("human_id"),
        *[F.coalesce(texts[k], F.lit("")).alias(k) for k in ("first", "last", "full", "address", "sku", "specialty")],
        (mail != "").alias("mailed"), email_trust(texts["email"]).alias("trust"))


def score_bound(pairs: DataFrame, domain: str, a: Column, b: Column) -> DataFrame:
    """Pairs with ``bound``: a score that theirs does not exceed, from exact signals, lengths and edit distance.

    ``a`` and ``b`` are profiles of the two records. The scorer itself runs over the highest value that each fuzzy signal
    can have; it never falls when a signal rises. Providers are scored by one of two formulas, of which the higher counts.
    """
    same = lambda k: F.when((a[k] != "") & (a[k] == b[k]), 1.0).otherwise(0.0)
    both = F.length(a["full"]) + F.length(b["full"])
    provider = domain == "PROVIDER"
    near = lambda k: F.lit(1.0) if provider else _winkler_bound(a[k], b[k])
    one = F.lit(1.0)
    df = pairs.withColumns({
        **{f"{s}_score": same(s) for s in EXACT_SIGNALS},
        "human_id_score": F.when((a["human_id"] != "") & (b["human_id"] != ""), same("human_id")),
        "source_score": source_trust(col_or_null(pairs, "a_source_system"), col_or_null(pairs, "b_source_system")),
        "name_score": near("first") if domain in ("PRODUCT", "SUPPLIER") else near("first") * 0.4 + near("last") * 0.6,
        "name_seq_score": F.when(both == 0, 1.0).otherwise(one - F.levenshtein(a["full"], b["full"]) / both),
        "address_score": near("address"),
        "email_score": one if provider else F.when(a["mailed"] & b["mailed"], F.least(one, a["trust"], b["trust"])).otherwise(0.0),
        "sku_score": near("sku"),
        "specialty_score": near("specialty"),
        **{f"{k}_score": one for k in ("provider_email", "product_id", "patient_id", "attribute")},
    })
    of = lambda name: score_pairs(df.withColumn("domain", F.lit(name)))
    if provider:
        other = of("OTHER").withColumnRenamed("entity_score", "_other").drop("learning_score")
        scored = score_pairs(other.withColumn("domain", F.lit(domain)))
        bound = F.greatest("entity_score", "_other")
    else:
        scored, bound = of(domain), F.col("entity_score")
    if domain == "PATIENT":
        bound = F.when(F.col("dob_score") == 1.0, PATIENT_MOST).otherwise(F.least("entity_score", F.lit(PATIENT_MOST)))
    return scored.select(*[F.col(f"`{c}`") for c in pairs.columns], F.round(bound, 6).alias("bound"))


def paired_records(
    records: DataFrame, mapping: ColumnMapping, domain: str = "CUSTOMER", least: float = LEAST, hot_block: int = HOT_BLOCK,
) -> DataFrame:
    """Every two records that share a block and can score ``least``, with ``blocks``, ``bound`` and the fields of both.

    Records equal in all mapped fields stand for each other: the one of smallest id (the first) meets the other records,
    and each further copy is paired with its first. ``blocks`` lists the kinds of key the two share. A null id takes no part.

    Inside a block, records meet only where they share a field of :func:`needed`, which loses no pair that can reach
    ``least``; the bound then drops the rest. Both records' lists of keys travel along, so a pair that shares several
    is kept at the first one and needs no further shuffle. With a threshold so low that nothing must be shared, every two
    records of a block are compared by their bound. Refined blocks above ``hot_block`` records are split: the smaller id of a
    pair carries a salt, and the larger one is handed to every salt.
    """
    domain, fields = domain.strip().upper(), mapping.fields()
    side = lambda s: [F.col(f"`{c}`").cast("string").alias(f"{s}_{k}") for k, c in fields.items()]
    names = [f"a_{k}" for k in fields]
    told = records.select(F.col(f"`{mapping.primary_key}`").cast("string").alias("a_id"), *side("a")).where("a_id is not null")
    known = ColumnMapping("a_id", **{k: f"a_{v}" for k, v in mapping.roles().items()})
    firsts = told.groupBy(*names).agg(F.min("a_id").alias("a_id")).withColumn("a_blocks", F.array_sort(_blocks(told, known)))
    firsts = firsts.where(F.size("a_blocks") > 0).withColumn("a_own", _profile(Sides(firsts), domain))
    # Keys and profiles are worked out once for each different record; copies and both sides of the pairs read them.
    firsts = stored(firsts, "match-records")

    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in names]
    copies = told.alias("t").join(firsts.alias("f"), same).where("t.a_id <> f.a_id").select(
        "f.a_id", F.col("t.a_id").alias("b_id"), F.col("f.a_blocks").alias("shared"),
        *[F.col(f"f.a_{k}").alias(f"{s}_{k}") for s in ("a", "b") for k in (*fields, "own")])

    signals = needed(domain, least)
    own = F.col("a_own")
    shown = lambda s: F.when(own[s] != "", F.struct(F.lit(s).alias("signal"), own[s].alias("value")))
    every = F.array(F.struct(F.lit("").alias("signal"), F.lit("").alias("value")))
    keys = every if signals is None else F.array_compact(F.array(*map(shown, signals)))
    keyed = firsts.withColumn("a_keys", keys).withColumn("block", F.explode("a_blocks")).withColumn("key", F.explode("a_keys"))
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_block)
    marked = keyed.join(sizes, ["block", "key"], "left")
    salts = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / max(hot_block, 1))).cast("int")
    small = marked.withColumn("salt", F.pmod(F.xxhash64("a_id"), salts).cast("int")).drop("n")
    large = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(
        "block", "key", "salt", F.col("a_blocks").alias("b_blocks"), F.col("a_keys").alias("b_keys"),
        *[F.col(f"a_{k}").alias(f"b_{k}") for k in ("id", *fields, "own")])
    met = small.join(large, ["block", "key", "salt"]).where(F.col("a_id") < F.col("b_id"))
    met = met.withColumn("shared", F.array_intersect("a_blocks", "b_blocks"))
    met = met.where((F.col("block") == F.col("shared")[0]) & (F.col("key") == F.array_intersect("a_keys", "b_keys")[0]))
    pairs = score_bound(met.select(*copies.columns).unionByName(copies), domain, F.col("a_own"), F.col("b_own"))
    pairs = pairs.where(F.col("bound") >= least - ROUNDING).withColumn("domain", F.lit(domain))
    return pairs.withColumn("blocks", F.array_join(F.array_distinct("shared.kind"), ",")).drop("shared", "a_own", "b_own")


def candidate_pairs(
    records: DataFrame, mapping: ColumnMapping, domain: str = "CUSTOMER", least: float = LEAST, hot_block: int = HOT_BLOCK,
) -> DataFrame:
    """Ids, shared kinds of block and score bound of :func:`paired_records`."""
    return paired_records(records, mapping, domain, least, hot_block).select("a_id", "b_id", "blocks", "bound")
