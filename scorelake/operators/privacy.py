"""Redaction, masking, markup removal, pseudonyms and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text import col, strip

# --- fixed values ---------------------------------------------------------------
REDACTED = "[REDACTED]"
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\d{3}-\d{3}-\d{4}\b",
    "card": r"\b\d{4}-\d{4}-\d{4}-\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "card_spaced": r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b",
}
SENSITIVE = (
    "password", "api_key", "secret", "token", "key", "credential", "ssn", "social_security",
    "credit_card", "card_number", "phone", "email", "address", "name", "username", "user_id",
    "session_id", "ip_address", "mac_address",
)
# Script and style bodies, dangerous protocols, event handlers, then every other tag.
MARKUP = (
    r"(?is)<script.*?>.*?</script>",
    r"(?i)javascript:",
    r"(?i)data:",
    r"(?i)vbscript:",
    r"(?iU)on\w+\s*=",
    r"(?is)<style.*?>.*?</style>",
    r"<[^>]*>",
)
# --------------------------------------------------------------------------------

# What a text must contain for the pattern to have a chance; most texts skip most patterns.
_HINTS = {
    "email": r"@", "ssn": r"\d-\d", "phone": r"\d-\d", "card": r"\d-\d", "ip_address": r"\d\.\d",
    "iban": r"[A-Za-z]{2}\d{2}", "card_spaced": r"\d{4}\s",
}


def redact(text: str | Column) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    hinted = out.rlike("(?U)" + "|".join(sorted(set(_HINTS.values()))))
    clean = out
    for pattern in PII_PATTERNS.values():
        clean = F.regexp_replace(clean, "(?iU)" + pattern, REDACTED)
    return F.when(hinted, clean).otherwise(out)


def pii_counts(text: str | Column) -> dict[str, Column]:
    return {
        n: F.when(col(text).rlike("(?U)" + _HINTS[n]), F.regexp_count(col(text), F.lit("(?iU)" + p))).otherwise(0)
        for n, p in PII_PATTERNS.items()
    }


def strip_markup(text: str | Column) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    for pattern in MARKUP:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def pseudonym(identifier: str | Column) -> Column:
    return F.substring(F.sha2(col(identifier).cast("string"), 256), 1, 16)


def _sensitive(name: str, terms: Sequence[str]) -> bool:
    return any(t in name.lower() for t in terms)


def _masked(value: Column, dtype: T.DataType, terms: Sequence[str]) -> Column:
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), redact(value))
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(REDACTED) if _sensitive(f.name, terms) else _masked(value[f.name], f.dataType, terms)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _masked(x, dtype.elementType, terms))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        pattern = "|".join(terms)
        if isinstance(dtype.valueType, T.StringType):
            return F.transform_values(
                value, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit(REDACTED)).otherwise(redact(v))
            )
        kept = F.transform_values(value, lambda _, v: _masked(v, dtype.valueType, terms))
        return F.map_filter(kept, lambda k, _: ~F.lower(k).rlike(pattern))
    return value


def mask_fields(df: DataFrame, terms: Sequence[str] = SENSITIVE) -> DataFrame:
    """Redacts sensitive fields by name and personal data in every other string.

    Works on the schema, into structs, arrays and maps.  A sensitive entry of a map
    whose values are not strings cannot hold the placeholder and is removed.
    """
    return df.select(*[
        (F.lit(REDACTED) if _sensitive(f.name, terms) else _masked(F.col(f.name), f.dataType, terms)).alias(f.name)
        for f in df.schema.fields
    ])


def audit_rows(
    df: DataFrame, prefix: str, event: str, participant: str, severity: str | None = None, at: str | None = None
) -> DataFrame:
    """Normalised audit table: prefixed type, hashed participant, level, JSON of the rest."""
    used = {event, participant, severity, at}
    rest = [c for c in df.columns if c not in used]
    level = F.lit("INFO")
    if severity:
        level = F.when(F.col(severity).isin("HIGH", "CRITICAL"), "WARNING").otherwise("INFO")
    details = mask_fields(df.select(F.struct(*rest).alias("details"))).schema["details"].dataType if rest else None
    body = F.to_json(_masked(F.struct(*rest), details, SENSITIVE)) if rest else F.lit("{}")
    return df.select(
        F.concat(F.lit(f"{prefix}_"), F.col(event)).alias("event_type"),
        pseudonym(participant).alias("participant_hash"), level.alias("level"),
        (F.col(at) if at else F.current_timestamp()).alias("timestamp"), body.alias("details"),
    )
