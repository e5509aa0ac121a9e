"""Text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters a Unicode-aware strip removes; ``trim`` alone would only remove blanks.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)

# Spaced street words shortened before two addresses are compared.
SPACED_SUFFIXES = {
    " street ": " st ",
    " avenue ": " ave ",
    " boulevard ": " blvd ",
    " road ": " rd ",
    " drive ": " dr ",
}

# Mailbox hosts that ignore dots and plus tags.
DOT_BLIND_HOSTS = ("gmail.com", "googlemail.com")

# Trust per mail domain.
BUSINESS_HOSTS = ("hospital.org", "baptisthealth.com", "acme.com")
PUBLIC_HOSTS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com")


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column if the frame has it, else a typed NULL (inputs may lack optional fields)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def has_text(c: Column) -> Column:
    """NOT NULL and not only blanks, never NULL itself."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def or_else(first: Column, *rest: Column) -> Column:
    """First value that is neither NULL nor the empty string; blanks count as values."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (first, *rest)])


def first_with_text(*cols: Column) -> Column:
    """First value with non-blank text, stripped; empty string when there is none."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def folded(c: Column) -> Column:
    """Lower-cased and stripped, NULL as empty string."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def compact(c: Column) -> Column:
    """Folded text without anything but letters, digits, ``@`` and blanks."""
    return F.regexp_replace(folded(c), "[^a-z0-9@ ]+", "")


def comparable_address(c: Column) -> Column:
    v = folded(c)
    for word, short in SPACED_SUFFIXES.items():
        v = F.replace(v, F.lit(word), F.lit(short))
    return F.regexp_replace(v, "[^a-z0-9 ]", "")


def comparable_email(c: Column) -> Column:
    """Mailbox in a comparable form: host kept, dots and tags dropped where the host ignores them."""
    v = folded(c)
    parts = F.split(v, "@", 2)
    local, host = parts[0], F.get(parts, F.lit(1))
    bare = F.split(F.replace(local, F.lit("."), F.lit("")), r"\+")[0]
    return F.when(~F.contains(v, F.lit("@")), v).otherwise(
        F.concat(F.when(host.isin(*DOT_BLIND_HOSTS), bare).otherwise(local), F.lit("@"), host)
    )


def email_trust(c: Column) -> Column:
    """Trust factor of the host after the first ``@``; 1.0 when there is none."""
    host = F.coalesce(F.get(F.split(folded(c), "@"), F.lit(1)), F.lit(""))
    host = strip(host)
    return (
        F.when(host.isin(*BUSINESS_HOSTS), F.lit(1.10))
        .when(F.endswith(host, F.lit(".edu")), F.lit(1.05))
        .when(host.isin(*PUBLIC_HOSTS), F.lit(0.95))
        .otherwise(F.lit(1.0))
    )


def titled(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
