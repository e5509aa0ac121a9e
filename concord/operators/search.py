"""Record search over the search index, one query at a time or many by a posting table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.sources.tables import stored

#: Longest stretches of a text that have postings.
GRAM = 3


def record_search(index: DataFrame, domain: str, text: str, limit: int = 20) -> DataFrame:
    """Records of a domain whose search text holds ``text``, any case; ``%`` and ``_`` are wildcards.

    A total order makes the limited result repeatable.
    """
    return (
        index.where((F.upper("domain") == domain.upper()) & F.lower("search_text").like(f"%{text.lower()}%"))
        .drop("search_text").orderBy("record_id").limit(limit)
    )


def _grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters of a text; none where it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))), F.array().cast("array<string>"))


def postings(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with a row number, and (domain, gram, row) for all stretches of up to GRAM characters of its texts.

    Both are tables of the shared folder, to be searched as often as one likes. The empty stretch lists every record.
    """
    rows = index.where("domain is not null and search_text is not null")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "search-index")
    low = F.lower("search_text")
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(low, n) for n in range(1, GRAM + 1)]))
    listed = rows.select(F.upper("domain").alias("domain"), F.explode(grams).alias("gram"), "_row")
    return rows, stored(listed.repartition("gram", "_row").sortWithinPartitions("gram"), "search-postings")


def _needed(pattern: Column) -> Column:
    """Stretches that a text must hold to fit the pattern: those of its parts between wildcards and escaped characters."""
    parts = F.filter(F.split(pattern, r"\\.|[%_]"), lambda p: p != "")
    of = lambda p: F.when(F.length(p) < GRAM, F.array(p)).otherwise(_grams(p, GRAM))
    found = F.array_distinct(F.flatten(F.transform(parts, of)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def search_many(rows: DataFrame, posted: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, fields of the record) of each query's first ``limit`` records, as :func:`record_search` finds them.

    ``queries`` has query_id, domain and text; ``rows`` and ``posted`` come from :func:`postings`. Each distinct query meets the
    postings of the rarest stretch that a fitting text must hold, and only these records are compared. A query with a stretch
    that stands nowhere ends before that. Null domains and texts find nothing.
    """
    asked = queries.select(
        "query_id", F.upper("domain").alias("_domain"), F.concat(F.lit("%"), F.lower("text"), F.lit("%")).alias("_pattern"))
    patterns = asked.where("_domain is not null and _pattern is not null").select("_domain", "_pattern").distinct()
    wanted = patterns.withColumn("gram", F.explode(_needed(F.col("_pattern"))))
    pairs = wanted.select(F.col("_domain").alias("domain"), "gram").distinct()
    sizes = posted.join(pairs, ["domain", "gram"], "left_semi").groupBy("domain", "gram").agg(F.count("*").alias("n"))
    sized = wanted.join(sizes.withColumnRenamed("domain", "_domain"), ["_domain", "gram"], "left")
    rarest = sized.groupBy("_domain", "_pattern").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    rarest = rarest.select("_pattern", F.col("_domain").alias("domain"), F.col("least.gram").alias("gram"))
    met = posted.join(rarest, ["domain", "gram"]).select("_pattern", F.col("domain").alias("_domain"), "_row")
    fitting = met.join(rows, "_row").where("lower(search_text) like _pattern")
    first = Window.partitionBy("_domain", "_pattern").orderBy("record_id", "_row")
    best = fitting.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    fields = [c for c in rows.columns if c not in ("_row", "search_text")]
    return asked.join(best, ["_domain", "_pattern"]).select("query_id", "rank", *fields)
