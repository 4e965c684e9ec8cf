"""Rules in YAML: waivers, expectations, conventions, clocks, safe cells."""

from __future__ import annotations

import warnings
from dataclasses import fields
from itertools import combinations

import yaml
from pyspark.sql import DataFrame, SparkSession

from gridweft.operators.convention import Rules

CONN_WAIVER = "pattern string, type string, reason string, source string, seq int"
CDC_WAIVER = "id string, crossing string, pattern string, reason string, owner string, date string, seq int"
EXPECT = "rule_kind string, from_pat string, to_pat string, seq int"


def _load(text: str) -> dict:
    found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def _text(value) -> str:
    return "" if value is None else str(value)


def conn_waivers(spark: SparkSession, text: str) -> DataFrame:
    """A text that isn't YAML only warns and waives nothing."""
    try:
        entries = _load(text).get("waivers") or []
    except yaml.YAMLError as e:
        warnings.warn(f"waivers are skipped: {e}", stacklevel=2)
        entries = []
    rows = [(_text(e.get("pattern")), _text(e.get("type") or "*"), _text(e.get("reason")), _text(e.get("source")), k) for k, e in enumerate(entries) if isinstance(e, dict)]
    return spark.createDataFrame(rows, CONN_WAIVER)


def cdc_waivers(spark: SparkSession, text: str) -> DataFrame:
    """Entries without an id are dropped."""
    entries = _load(text).get("waivers") or []
    rows = [(*(_text(e.get(c)) for c in ("id", "crossing", "pattern", "reason", "owner", "date")), k) for k, e in enumerate(entries) if isinstance(e, dict) and e.get("id")]
    return spark.createDataFrame(rows, CDC_WAIVER)


def expectations(spark: SparkSession, text: str) -> DataFrame:
    """Expected and forbidden links; a text that isn't YAML raises."""
    doc = _load(text)
    rows = [(kind, _text(e.get("from")), _text(e.get("to")), k) for kind in ("expected", "forbidden") for k, e in enumerate(doc.get(kind) or [])]
    return spark.createDataFrame(rows, EXPECT)


def convention_rules(text: str) -> Rules:
    """Rules with the defaults for what is missing or of the wrong kind; lists may be comma-separated."""
    doc, out = _load(text), Rules()
    for f in fields(Rules):
        if f.name not in doc:
            continue
        value, default = doc[f.name], getattr(out, f.name)
        if isinstance(default, list):
            parts = value if isinstance(value, list) else _text(value).split(",")
            setattr(out, f.name, [_text(p).strip() for p in parts if _text(p).strip()])
        elif isinstance(default, bool):
            setattr(out, f.name, value if isinstance(value, bool) else default)
        elif isinstance(default, int):
            setattr(out, f.name, value if isinstance(value, int) and not isinstance(value, bool) else default)
        else:
            setattr(out, f.name, _text(value))
    return out


# Nanoseconds of one cycle by the unit of a frequency (fixed values).
UNITS = {"khz": 1e6, "mhz": 1e3, "ghz": 1.0}


def period_ns(frequency: str) -> float | None:
    """1000 / MHz and so on; None for what is no frequency."""
    word = _text(frequency).strip().lower()
    for unit, ns in UNITS.items():
        if word.endswith(unit):
            try:
                value = float(word[: -len(unit)])
            except ValueError:
                return None
            return ns / value if value else None
    return None


def clock_rules(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(clocks (name, period_ns), relations (a, b, relationship)) of clock_sources and domain_groups.

    Within a group all clocks have its relation to each other.
    """
    doc = _load(text)
    clocks = [(_text(c.get("name")), period_ns(c.get("frequency"))) for c in doc.get("clock_sources") or [] if isinstance(c, dict)]
    pairs = [(a, b, _text(g.get("type") or "Asynchronous")) for g in doc.get("domain_groups") or [] if isinstance(g, dict) for a, b in combinations([_text(x) for x in g.get("clocks") or []], 2)]
    return spark.createDataFrame(clocks, "name string, period_ns double"), spark.createDataFrame(pairs, "a string, b string, relationship string")


def add_clocks(sources: DataFrame, clocks: DataFrame) -> DataFrame:
    """Sources and those of the clocks whose name none of them has."""
    from pyspark.sql import functions as F

    new = clocks.join(sources.select("name"), "name", "left_anti")
    return sources.unionByName(new.select(F.concat(F.lit("yaml_"), F.col("name")).alias("source_id"), "name", "period_ns"), allowMissingColumns=True)


def safe_cells(text: str, flags: tuple[str, ...] = (), defaults: tuple[str, ...] = ()) -> tuple[set[str], set[str]]:
    """(multiplexer cells, synchronizer cells): defaults, flags and the file's lists; the latter have no effect."""
    doc = _load(text)
    return {*defaults, *flags, *map(_text, doc.get("safe_mux_cells") or [])}, {*map(_text, doc.get("safe_sync_cells") or [])}
