"""Label, threat and coercion expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels that count as normal traffic, threat levels in rising order.
BENIGN_LABELS = ["benign", "normal", "benign traffic"]
THREAT_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def is_benign(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(BENIGN_LABELS)


def threat_bucket(label: Column) -> Column:
    """Threat of a traffic class; the tests run in this order."""
    name = F.lower(label)

    def has(*words: str) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(name, F.lit(word))
        return test

    return (
        F.when(is_benign(label), "LOW")
        .when(has("ddos", "critical", "bot"), "CRITICAL")
        .when(has("dos", "slowloris", "goldeneye"), "HIGH")
        .otherwise("MEDIUM")
    )


def system_threat(total: Column, benign: Column) -> Column:
    ratio = F.when(total > 0, (total - benign) / total).otherwise(F.lit(0.0))
    return F.when(ratio == 0, "LOW").when(ratio <= 0.05, "MEDIUM").when(ratio <= 0.20, "HIGH").otherwise("CRITICAL")


def message_threat(info: Column, default: Column) -> Column:
    """Threat named inside the message, tested from the worst level down, else the detector's own."""
    text = F.lower(info)
    out = F.when(F.contains(text, F.lit("critical")), "CRITICAL")
    for level in ("HIGH", "MEDIUM", "LOW"):
        out = out.when(F.contains(text, F.lit(level.lower())), level)
    return out.otherwise(default)


def alert_type(info: Column, detector: Column) -> Column:
    return F.when(F.contains(info, F.lit(" - ")), F.substring_index(info, " - ", 1)).otherwise(detector)


def threat_rank(threat: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in THREAT_LEVELS]), threat)


def coerce_number(value: Column, mean: Column) -> Column:
    """Number from text; infinite, missing and non-numeric values become the mean."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, number).otherwise(mean)
