"""Column expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelane.schemas import ORDER_POLICIES, RESOURCES, RESOURCES_JSON, TASK_STATES


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def canonical_pair(a: Column, b: Column) -> Column:
    """The unordered pair ``{a, b}`` as a struct with its smaller member first."""
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def epoch_minute(ts: Column) -> Column:
    """Whole minutes since the epoch; accepts ``timestamp`` and ``timestamp_ntz``."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000)).cast("bigint")


def ring_slot(minute: Column, slots: int = 60) -> Column:
    return F.pmod(minute, F.lit(slots))


def parse_resources(text: Column) -> Column:
    """JSON list of resources to a typed array; a missing list is an empty one."""
    parsed = F.from_json(text, RESOURCES_JSON)
    renamed = F.transform(
        parsed,
        lambda r: F.struct(
            r["resourceClass"].alias("resource_class"), r["resourceId"].alias("resource_id")
        ),
    )
    return F.coalesce(renamed, F.array().cast(RESOURCES))


def resources_json(resources: Column) -> Column:
    """Typed resource array to JSON; an empty array is stored as NULL."""
    renamed = F.transform(
        resources,
        lambda r: F.struct(
            r["resource_class"].alias("resourceClass"), r["resource_id"].alias("resourceId")
        ),
    )
    return F.when(F.size(resources) > 0, F.to_json(renamed))


def dsl_field(dsl: Column, name: str) -> Column:
    return F.get_json_object(dsl, f"$.{name}")


def or_empty_json(c: Column) -> Column:
    return F.coalesce(c, F.lit("{}"))


def iso_duration_ms(text: Column) -> Column:
    """ISO-8601 duration text (``PT0.1S``, ``PT5M``, ``P1DT2H``) to whole milliseconds."""

    def part(pattern: str, unit_ms: int) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        return F.coalesce(found.cast("decimal(20,9)"), F.lit(0).cast("decimal(20,9)")) * F.lit(unit_ms)

    total = (
        part(r"^P(\d+)D", 86_400_000)
        + part(r"T(\d+)H", 3_600_000)
        + part(r"T(?:\d+H)?(\d+)M", 60_000)
        + part(r"(\d+(?:\.\d+)?)S$", 1_000)
    )
    return F.when(text.isNotNull(), F.floor(total).cast("bigint"))


def ms_iso_duration(ms: Column) -> Column:
    """Milliseconds to the shortest ISO-8601 text: 100 gives ``PT0.1S``, 300000 ``PT5M``."""
    hours = F.floor(ms / 3_600_000)
    minutes = F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000)
    seconds = F.floor(F.pmod(ms, F.lit(60_000)) / 1_000)
    fraction = F.rtrim(
        F.lpad(F.pmod(ms, F.lit(1_000)).cast("string"), 3, "0"), F.lit("0")
    )
    with_fraction = F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise("")
    has_seconds = (F.pmod(ms, F.lit(60_000)) > 0) | (ms == 0)
    return F.concat(
        F.lit("PT"),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
        F.when(
            has_seconds, F.concat(seconds.cast("string"), with_fraction, F.lit("S"))
        ).otherwise(""),
    )


def parse_instant(text: Column) -> Column:
    return F.to_timestamp(text)


def format_instant(ts: Column) -> Column:
    """UTC instant text; fractional digits only where they are needed."""
    base = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts.cast("timestamp"), "SSSSSS")
    fraction = (
        F.when(micros == "000000", F.lit(""))
        .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(base, fraction, F.lit("Z"))


def name_uuid(name: Column) -> Column:
    """Version-3 UUID of a text: MD5 with the version and variant bits set."""
    h = F.md5(name.cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8),
        F.lit("-"),
        F.substring(h, 9, 4),
        F.lit("-3"),
        F.substring(h, 14, 3),
        F.lit("-"),
        variant,
        F.substring(h, 18, 3),
        F.lit("-"),
        F.substring(h, 21, 12),
    )


def uuid_text(c: Column) -> Column:
    """Canonical form of a UUID text; NULL where it is not one."""
    low = F.lower(F.trim(c))
    ok = low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(ok, low)


def at_least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), c)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def integer_mean(total: Column, n: Column) -> Column:
    return F.floor(total / n).cast("bigint")


def state_name(c: Column) -> Column:
    name = F.upper(F.trim(c))
    return F.when(name.isin(*TASK_STATES), name)


def policy_name(c: Column) -> Column:
    """Policy names are read without regard to case; unknown ones mean FIFO."""
    name = F.upper(F.trim(c))
    return F.when(name.isin(*ORDER_POLICIES), name).otherwise(F.lit("FIFO"))


def failure_text(error_type: Column, error_message: Column, reason: Column) -> Column:
    thrown = F.concat(error_type, F.lit(": "), F.coalesce(error_message, F.lit("null")))
    return F.coalesce(thrown, reason, F.lit("failed"))


def lookup_outcome(error_type: Column) -> Column:
    """Outcome label of a resource lookup: no error, a timeout by class name, any other."""
    return (
        F.when(error_type.isNull(), F.lit("success"))
        .when(error_type.contains("Timeout") | error_type.contains("TimedOut"), F.lit("timeout"))
        .otherwise(F.lit("failure"))
    )


def serial_waves(ids: Column) -> Column:
    """One single-member wave per id, numbered from 0."""
    return F.transform(
        ids, lambda x, i: F.struct(i.cast("int").alias("colour"), F.array(x).alias("taskIds"))
    )
