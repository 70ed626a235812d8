"""Typed entities out of untyped payload rows (H-15): a row is a map of strings, whatever its producer calls a field.

Each entity is one select over the map: aliases are tried in order, numbers lose their units, states and enumerations are
mapped whatever the case of letters, and what is missing takes the entity's default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.normalise import HEALTH

#: The enumerations of an entity's fields, the first being the default.
ENVIRONMENTS, CHECK_TYPES, METHODS = ("QA", "Staging", "Production"), ("HTTP", "API", "FUNCTIONAL"), ("GET", "POST", "HEAD")
OUTCOMES = ("failed", "succeeded", "scheduled", "info")
_FUNCTIONAL = ("functionalValidation", "Functional Validation")


def payload_rows(df: DataFrame, json_col: str) -> DataFrame:
    """df with `row`, the fields of a JSON object as strings (nested ones as JSON text); null if it is not an object."""
    return df.withColumn("row", F.from_json(F.col(json_col), "map<string,string>"))


def pick(*keys: str) -> Column:
    """The first of the row's fields that is there and not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at("row", F.lit(k)), F.lit("")) for k in keys])


def text(value: Column, default: str | None = None) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def number(value: Column, default: float | None = None) -> Column:
    """The number in a text with units; the default if there is none."""
    return F.coalesce(F.nullif(F.regexp_replace(value, "[^0-9.+-]", ""), F.lit("")).try_cast("double"), F.lit(default).cast("double"))


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes", "y"), F.lit(False))


def one_of(value: Column, values: tuple[str, ...], default: str | None = None) -> Column:
    """One of the values, whatever the case of letters, else the default (the first, if none is given)."""
    found = F.lit(default or values[0])
    for v in values:
        found = F.when(F.upper(F.trim(value)) == v.upper(), v).otherwise(found)
    return found


def slug(value: Column) -> Column:
    return F.concat(F.lit("svc-"), F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def _state(said: Column, code: Column, ms: Column) -> Column:
    """The state that a row says, else what its code and time say (H-07, H-10)."""
    stated = F.lit("UNKNOWN")
    for spelling, state in HEALTH.items():
        stated = F.when(said == spelling, state).otherwise(stated)
    derived = F.when(code >= 400, "DOWN").when(ms > 3000, "SLOW").otherwise("HEALTHY")
    return F.when((stated != "UNKNOWN") | code.isNull(), stated).otherwise(derived)


def services(rows: DataFrame, *keep: str) -> DataFrame:
    # as in log_entries: each field is taken out of the map once, and read once
    fields = {
        "_http": pick("httpStatus", "HTTP Status", "httpCode"), "_ms": pick("responseTimeMs", "Response Time Ms"), "_said": pick("status", "healthStatus", "Health Status"),
        "_env": pick("environment", "Environment"), "_check": pick("checkType", "Check Type"), "_method": pick("httpMethod", "method"), "_expected": pick("expectedStatus"),
        "_threshold": pick("responseTimeThresholdMs", "Response Time Threshold Ms"), "_critical": pick("critical", "Critical"), "_attempts": pick("attempts"), "_retries": pick("retryCount", "Retry Count"),
        "_id": pick("id"), "_name": pick("name", "serviceName", "Service Name"), "_policy": F.from_json(pick("retryPolicy"), "struct<maxAttempts:string,delaysSeconds:array<string>>"),
    }
    taken = rows.select(*keep, *[c.alias(n) for n, c in fields.items()])
    numbers = {n: number(F.col(n)) for n in ("_http", "_ms", "_expected", "_threshold", "_attempts", "_retries")}
    states = {n: F.upper(F.trim(n)) for n in ("_env", "_check", "_method")} | {"_said": F.upper(F.trim(F.coalesce("_said", F.lit(""))))}
    read = taken.withColumns(numbers | states | {"_id": text(F.col("_id")), "_name": text(F.col("_name"), "Unknown Service")})
    read = read.withColumn("_env", one_of(F.col("_env"), ENVIRONMENTS))
    delays = F.filter(F.transform(F.col("_policy")["delaysSeconds"], lambda d: number(d, 0)), lambda d: d > 0)
    return read.select(
        *keep,
        F.coalesce("_id", slug(F.concat_ws("-", "_env", "_name"))).alias("id"),
        F.col("_name").alias("name"),
        F.col("_env").alias("environment"),
        one_of(F.col("_check"), CHECK_TYPES).alias("check_type"),
        one_of(F.col("_method"), METHODS).alias("method"),
        F.coalesce("_expected", F.lit(200.0)).cast("int").alias("expected_status"),
        F.coalesce("_threshold", F.lit(3000.0)).alias("threshold_ms"),
        flag(F.col("_critical")).alias("critical"),
        number(F.col("_policy")["maxAttempts"], 3).cast("int").alias("max_attempts"),
        F.coalesce(delays, F.array(F.lit(20.0), F.lit(30.0))).alias("delays"),
        _state(F.col("_said"), F.col("_http"), F.col("_ms")).alias("status"),
        F.col("_http").cast("int").alias("http_status"),
        F.coalesce("_ms", F.lit(0.0)).alias("response_ms"),
        F.coalesce(F.nullif("_attempts", F.lit(0.0)), F.coalesce("_retries", F.lit(0.0)) + 1).cast("int").alias("attempts"),
    )


def log_entries(rows: DataFrame, *keep: str) -> DataFrame:
    # fields are taken out of the map once, and states and numbers read once, in selects of their own
    fields = {
        "_http": pick("httpCode", "httpStatus", "HTTP Status"), "_stated_http": pick("httpStatus", "HTTP Status", "httpCode"), "_ms": pick("responseTimeMs", "Response Time Ms"),
        "_said": pick("status", "healthStatus", "Health Status"), "_env": pick("environment", "Environment"), "_attempt": pick("attempt"), "_retries": pick("retryCount", "Retry Count"),
        "_most": pick("maxAttempts"), "_id": pick("serviceId"), "_name": pick("serviceName", "Service Name"), "_message": pick("message"),
    }
    taken = rows.select(*keep, *[c.alias(n) for n, c in fields.items()])
    numbers = {n: number(F.col(n)) for n in ("_http", "_stated_http", "_ms", "_attempt", "_retries", "_most")}
    read = taken.withColumns(numbers | {"_said": F.upper(F.trim(F.coalesce("_said", F.lit("")))), "_env": F.upper(F.trim("_env"))})
    code, ms = F.col("_http").cast("int"), F.coalesce("_ms", F.lit(0.0))
    told = F.when(code.isNull(), "No response recorded").otherwise(F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" in "), ms.cast("long").cast("string"), F.lit(" ms")))
    return read.select(
        *keep,
        F.coalesce(text(F.col("_id")), slug(text(F.col("_name"), "Unknown Service"))).alias("service_id"),
        one_of(F.col("_env"), ENVIRONMENTS).alias("environment"),
        F.coalesce(F.nullif("_attempt", F.lit(0.0)), F.coalesce("_retries", F.lit(0.0)) + 1).cast("int").alias("attempt"),
        F.coalesce("_most", F.lit(3.0)).cast("int").alias("max_attempts"),
        _state(F.col("_said"), F.col("_stated_http"), F.col("_ms")).alias("status"),
        code.alias("http_code"),
        ms.alias("response_ms"),
        F.coalesce(text(F.col("_message")), told).alias("message"),
    )


def retry_attempts(rows: DataFrame, *keep: str) -> DataFrame:
    attempt = number(pick("attempt"), 1).cast("int")
    said = F.lower(text(pick("outcome", "status"), "failed"))
    return rows.select(
        *keep,
        text(pick("incidentId", "Incident ID")).alias("incident_id"),
        attempt.alias("attempt"),
        F.when(said.isin(*OUTCOMES), said).otherwise("info").alias("outcome"),
        number(pick("scheduledDelaySeconds", "delaySeconds")).alias("delay_s"),
        F.coalesce(text(pick("message")), F.concat(F.lit("Retry attempt "), attempt.cast("string"), F.lit(" recorded"))).alias("message"),
    )


def metrics(rows: DataFrame, *keep: str) -> DataFrame:
    name = text(pick("serviceName", "Service Name"), "Unknown Service")
    return rows.select(*keep, F.coalesce(text(pick("serviceId")), slug(name)).alias("service_id"), name.alias("name"), number(pick("responseTimeMs", "Response Time Ms"), 0).alias("response_ms"), number(pick("thresholdMs", "responseTimeThresholdMs"), 3000).alias("threshold_ms"))


def summary(rows: DataFrame, of: DataFrame) -> DataFrame:
    """What a summary's row says, and where it says nothing what the services (of services()) say."""
    down = F.count_if(F.col("status").isin("DOWN", "FUNCTIONAL_FAILURE"))
    told = of.agg(F.count("*").alias("n"), down.alias("down"), F.coalesce(F.floor(F.avg("response_ms") + 0.5), F.lit(0)).cast("double").alias("mean_ms"))
    said = F.upper(F.trim(F.coalesce(pick("overallStatus", "status"), F.lit(""))))
    reported = F.lit("UNKNOWN")
    for spelling, state in HEALTH.items():
        reported = F.when(said == spelling, state).otherwise(reported)
    one = rows.join(F.broadcast(told), F.lit(True))  # one row of sums
    return one.select(
        F.when(reported != "UNKNOWN", reported).when(F.col("down") > 0, "DOWN").otherwise("HEALTHY").alias("overall_status"),
        F.coalesce(number(pick("servicesMonitored")), F.col("n").cast("double")).cast("long").alias("monitored"),
        F.coalesce(number(pick("healthyServices")), (F.col("n") - F.col("down")).cast("double")).cast("long").alias("healthy"),
        F.coalesce(number(pick("failedServices")), F.col("down").cast("double")).cast("long").alias("failed"),
        F.coalesce(number(pick("averageResponseTimeMs")), F.col("mean_ms")).alias("mean_ms"),
    )
