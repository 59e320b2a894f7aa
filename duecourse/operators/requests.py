"""Applications as JSON text: writing them from loans, checking them, typing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecourse.functions import parsing as P
from duecourse.operators.contracts import numeric_problem
from duecourse.registry import EVENT_DATE, Registry

DATE_FIELD = "application_date"
# Columns between the steps of a reading.
TEXT, KEYS, VALUE, REASONS = "_read_text", "_read_keys", "_read_value_", "_read_reasons"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def request_fields(registry: Registry) -> list[str]:
    return [DATE_FIELD, *registry.features]


def request_json(registry: Registry) -> Column:
    """The JSON body of a typed loan: missing values as null, dates as ISO text."""
    fields = [F.col(EVENT_DATE).alias(DATE_FIELD), *(F.col(c) for c in registry.features)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def read_requests(
    bodies: DataFrame, registry: Registry, body: str = "body", today: Column | None = None
) -> DataFrame:
    """Add the typed ``request`` and the ``reasons`` (empty when accepted) to each body.

    Every field is first read as text, so a value of the wrong type is reported, not lost.
    """
    names = request_fields(registry)
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # Three projections, each over columns that the one before makes once: text, typed values, reasons.
    # Catalyst keeps them apart, as every column made is used more than once.
    parsed = bodies.withColumns({TEXT: F.from_json(body, as_text), KEYS: F.json_object_keys(body)})
    typed = parsed.withColumns(_typed_fields(registry, today))
    judged = typed.withColumn(REASONS, F.array_compact(_reasons(registry)))
    result = F.struct(
        F.struct(*(_value(n).alias(n) for n in names)).alias("request"), F.col(REASONS).alias("reasons")
    )
    # Filters on the result are not moved below an explode, where they would repeat parse and checks.
    # What is exploded holds columns only: a generator's own expressions are neither shared nor compiled
    # once they are many.
    checked = judged.select(*bodies.columns, F.explode(F.array(result)).alias("_result"))
    return checked.select(*bodies.columns, "_result.request", "_result.reasons")


def _text(name: str) -> Column:
    return F.col(f"{TEXT}.{name}")


def _value(name: str) -> Column:
    return F.col(f"{VALUE}{name}")


def _day(text: Column) -> Column:
    return F.when(text.rlike(DAY), F.try_to_date(text, "yyyy-MM-dd"))


def _typed_fields(registry: Registry, today: Column | None) -> dict[str, Column]:
    default = F.current_date() if today is None else today
    absent = ~F.array_contains(KEYS, DATE_FIELD)
    fields = {DATE_FIELD: F.when(absent, default).otherwise(_day(_text(DATE_FIELD)))}
    fields |= {c: P.number(_text(c)) for c in registry.numeric}
    fields |= {c: _text(c) for c in registry.categorical}
    fields |= {c: _day(_text(c)) for c in registry.dates}
    return {f"{VALUE}{name}": made for name, made in fields.items()}


def _reasons(registry: Registry) -> Column:
    """One array per body; NULL entries are removed by the caller."""
    is_object = F.col(KEYS).isNotNull()
    checks: list[tuple[Column, str]] = []
    for name in (*registry.required, *registry.categorical, *registry.dates):
        checks.append((_text(name).isNull(), f"{name}: missing"))
    present = F.array_contains(KEYS, DATE_FIELD)
    checks.append((present & _text(DATE_FIELD).isNull(), f"{DATE_FIELD}: missing"))
    for name in (DATE_FIELD, *registry.numeric, *registry.dates):
        checks.append((_text(name).isNotNull() & _value(name).isNull(), f"{name}: unreadable"))
    for name in registry.numeric:
        checks.append((numeric_problem(name, registry, _value(name)), f"{name}: out of range"))
    for name in registry.categorical:
        checks.append((~_value(name).isin(registry.allowed[name]), f"{name}: not allowed"))
    checks.append(
        (_value("fico_range_high") < _value("fico_range_low"), "fico_range_high: below fico_range_low")
    )
    for name in registry.dates:  # compares days; the batch contract compares months
        checks.append((_value(name) > _value(DATE_FIELD), f"{name}: after {DATE_FIELD}"))
    listed = F.array(
        F.when(~is_object, F.lit("not a JSON object")),
        *(F.when(is_object & bad, F.lit(text)) for bad, text in checks),
    )
    known = F.array(*(F.lit(n) for n in request_fields(registry)))
    unknown = F.coalesce(F.array_except(KEYS, known), F.array().cast("array<string>"))
    return F.concat(listed, F.transform(unknown, lambda n: F.concat(n, F.lit(": unknown field"))))


def accepted(read: DataFrame) -> DataFrame:
    return read.filter(F.size("reasons") == 0).drop("reasons")


def quarantined(read: DataFrame) -> DataFrame:
    return read.filter(F.size("reasons") > 0).drop("request")


def applications(read: DataFrame, registry: Registry) -> DataFrame:
    """Accepted requests with the columns and types of cleaned loans: dates at month starts."""
    others = [c for c in read.columns if c not in ("request", "reasons")]
    return accepted(read).select(
        *others,
        F.trunc(f"request.{DATE_FIELD}", "MM").alias(EVENT_DATE),
        *(F.col(f"request.{c}").alias(c) for c in registry.numeric + registry.categorical),
        *(F.trunc(f"request.{c}", "MM").alias(c) for c in registry.dates),
    )
