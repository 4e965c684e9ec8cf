"""Naming and source-text rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators.graph import reach
from gridweft.sources.style import TEXT_RULES


@dataclass
class Rules:
    """What is checked; an empty text, an empty list, zero or False switches a rule off."""

    input_prefix: str = "i_"
    output_prefix: str = "o_"
    instance_prefix: str = "u_"
    clock_pattern: str = ""
    reset_pattern: str = ""
    active_low_suffix: str = ""
    lowercase_port_names: bool = False
    parameter_pattern: str = ""
    typedef_pattern: str = ""
    input_suffixes: list[str] = field(default_factory=list)
    output_suffixes: list[str] = field(default_factory=list)
    inout_suffixes: list[str] = field(default_factory=list)
    reject_digit_suffix: bool = False
    max_line_length: int = 0
    prohibit_tabs: bool = False
    prohibit_trailing_blanks: bool = False
    one_module_per_file: bool = False
    file_module_match: bool = False


def _like(column: Column, pattern: str) -> Column:
    """Full match of a user's pattern; never where there is none or it isn't safe."""
    return column.rlike(f"^(?:{pattern})$") if pattern and names.safe_pattern(pattern) else F.lit(False)


def _named(prefix: str, suffixes: list[str]) -> Column:
    port = F.col("port_name")
    ok = port.startswith(prefix) if prefix else F.lit(False)
    for s in filter(None, suffixes):
        ok = ok | port.endswith(s)
    return ok if prefix or any(suffixes) else F.lit(True)


def check_ports(ports: DataFrame, rules: Rules) -> DataFrame:
    """(rule, instance_path, name): a row for each rule that a port breaks.

    All rules are computed in one pass as an array of broken ones, so that ports are read once.
    """
    port, direction = F.col("port_name"), F.col("direction")
    clock, reset = _like(port, rules.clock_pattern), _like(port, rules.reset_pattern)
    broken = {
        "lowercase": port.rlike("[A-Z]") if rules.lowercase_port_names else F.lit(False),
        "active_low": (direction == "In") & port.endswith(rules.active_low_suffix) & ~reset & ~clock if rules.active_low_suffix else F.lit(False),
        "digit_suffix": port.rlike("_[0-9]+$") if rules.reject_digit_suffix else F.lit(False),
        "input_name": (direction == "In") & ~clock & ~reset & ~_named(rules.input_prefix, rules.input_suffixes),
        "output_name": (direction == "Out") & ~_named(rules.output_prefix, rules.output_suffixes),
        "inout_name": (direction == "InOut") & ~_named("", rules.inout_suffixes) if rules.inout_suffixes else F.lit(False),
    }
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in broken.items()]), lambda x: x.isNotNull())
    return ports.select(F.explode(found).alias("rule"), "instance_path", port.alias("name"))


def check_instances(instances: DataFrame, rules: Rules) -> DataFrame:
    """Instances below top without the prefix, once each."""
    rows = instances.where("parent_path IS NOT NULL AND parent_path <> ''")
    rows = rows.where(~F.col("name").startswith(rules.instance_prefix)) if rules.instance_prefix else rows.limit(0)
    return rows.select(F.lit("instance_prefix").alias("rule"), F.col("path").alias("instance_path"), "name").distinct()


def check_declarations(declarations: DataFrame, rules: Rules) -> DataFrame:
    """Parameters that don't match in full, typedefs in which the pattern isn't found."""
    name, kind = F.col("name"), F.col("decl_kind")
    parameter = (kind == "parameter") & ~_like(name, rules.parameter_pattern) if rules.parameter_pattern and names.safe_pattern(rules.parameter_pattern) else F.lit(False)
    typedef = (kind == "typedef") & ~name.rlike(rules.typedef_pattern) if rules.typedef_pattern and names.safe_pattern(rules.typedef_pattern) else F.lit(False)
    return declarations.where(parameter | typedef).select(F.concat(kind, F.lit("_name")).alias("rule"), F.col("scope_path").alias("instance_path"), "name")


def missing_d_suffix(signals: DataFrame) -> DataFrame:
    """Bases with a _q but no _d signal in scopes that have combinational logic (scope_path, name, has_comb)."""
    base = lambda s: signals.where(F.col("name").endswith(s)).select("scope_path", F.expr("left(name, length(name) - 2)").alias("base"), "has_comb")
    return base("_q").where("has_comb").select("scope_path", "base").distinct().join(base("_d").select("scope_path", "base"), ["scope_path", "base"], "left_anti")


def style_issues(observations: DataFrame) -> DataFrame:
    """Observations of style (kind, scope_path, name, detail, line, col) as informational issues."""
    none = F.lit(None).cast("string")
    port = F.when(F.coalesce("name", F.lit("")) == "", F.lit("<no-name>")).otherwise(F.col("name"))
    place = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    return observations.select(F.lit("CONVENTION").alias("type"), F.lit("INFO").alias("severity"), F.col("scope_path").alias("instance"), port.alias("port"), none.alias("source"), none.alias("dest"), "detail", "kind", place("line"), place("col"))


def placed_style(found: DataFrame, instances: DataFrame) -> DataFrame:
    """Remarks of ``sources.style`` as observations of a design (kind, scope_path, name, detail, line, col).

    Rules of the elaborated design hold in each instance (path, module) of their module, scope
    labels included; those of the text are told once, with the file. Modules that the design
    doesn't hold give none.
    """
    text = F.col("kind").isin(*TEXT_RULES)
    used = instances.select("module").distinct()
    once = found.where(text).join(used, "module", "left_semi").withColumn("scope_path", F.col("file"))
    scope = F.concat_ws(".", "path", F.when(F.col("scope") != "", F.col("scope")))
    each = found.where(~text).join(instances.select("path", "module"), "module").withColumn("scope_path", scope)
    columns = ["kind", "scope_path", "name", "detail", "line", "col"]
    return once.select(*columns).unionAll(each.select(*columns))


def reachable_modules(instantiates: DataFrame, top: str) -> DataFrame:
    """Modules that top instantiates, itself included, with their distance."""
    edges = instantiates.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    seed = instantiates.sparkSession.createDataFrame([(top,)], "node string")
    return reach(edges, seed).select(F.col("node").alias("module"), "depth")


def admitted_files(modules: DataFrame, reachable: DataFrame) -> DataFrame:
    """Files any of whose modules is reachable."""
    return modules.join(reachable.select("module"), "module", "left_semi").select("file").distinct()


def lines_of(texts: DataFrame) -> DataFrame:
    """(file, line_no, text) of texts (file, text), carriage returns stripped, lines from 1."""
    parts = F.posexplode(F.split(F.col("text"), "\n"))
    return texts.select("file", parts.alias("pos", "raw")).select("file", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("text"))


def check_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """(rule, file, line_no, column): long lines (in bytes), tabs, trailing blanks (unless the tab is reported)."""
    text = F.col("text")
    tab = text.contains("\t")
    long = F.octet_length(text) > rules.max_line_length if rules.max_line_length > 0 else F.lit(False)
    blank = text.rlike("[ \t]$")
    trailing = blank & ~(tab & F.lit(rules.prohibit_tabs) & text.rlike("\t$")) if rules.prohibit_trailing_blanks else F.lit(False)
    found = F.array(
        F.when(long, F.struct(F.lit("line_too_long").alias("rule"), F.lit(rules.max_line_length + 1).alias("column"))),
        F.when(tab & F.lit(rules.prohibit_tabs), F.struct(F.lit("hard_tab").alias("rule"), F.instr(text, "\t").alias("column"))),
        F.when(trailing, F.struct(F.lit("trailing_whitespace").alias("rule"), (F.length(F.regexp_replace(text, "[ \t]+$", "")) + 1).alias("column"))),
    )
    return lines.select("file", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.rule", "file", "line_no", "f.column")


def check_files(modules: DataFrame, rules: Rules) -> DataFrame:
    """Files with several modules, and single-module files of another name."""
    per = modules.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("module").alias("module"))
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    many = per.where("n > 1").select(F.lit("multiple_modules").alias("rule"), "file", "n") if rules.one_module_per_file else None
    other = per.where((F.col("n") == 1) & (stem != F.col("module"))).select(F.lit("file_name").alias("rule"), "file", "n") if rules.file_module_match else None
    if many is None and other is None:
        return per.limit(0).select(F.lit("").alias("rule"), "file", "n")
    return many if other is None else other if many is None else many.unionByName(other)
