"""Registered queries over the driver tables, their DuckDB counterparts, and the comparison tool."""

import importlib

MODULES = ["traffic", "payloads", "detectors", "rulesets", "flows", "feeds", "streams", "files"]


def load():
    from checks.registry import REGISTERED

    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return REGISTERED
