"""The session's settings of the engine, by their keys in spark.conf."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Key, what holds without it, and what it may be (None: a number).
SETTINGS = {
    "plyweave.product": ("auto", ("auto", "join", "blocked")),
    "plyweave.context": ("8192", None),
    "plyweave.profile": ("false", ("false", "true")),
}


def setting(spark: SparkSession, key: str) -> str | int:
    """A setting's value; wrong ones raise."""
    rest, allowed = SETTINGS[key]
    value = spark.conf.get(key, rest)
    if allowed is None:
        if not value.isdigit():
            raise ValueError(f"{key} is {value!r}, not a number")
        return int(value)
    if value not in allowed:
        raise ValueError(f"{key} is {value!r}, not one of {', '.join(allowed)}")
    return value
