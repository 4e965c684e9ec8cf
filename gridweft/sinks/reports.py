"""Reports as rows of text, so that large ones are written by the executors.

Functions that end in ``_lines`` return a DataFrame (line) or (seq, line); ``write_lines`` writes it.
Summaries of a fixed number of rows are built on the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators.graph import ranked

DEFAULT_PERIOD = "10.0"


def json_lines(rows: DataFrame) -> DataFrame:
    """A JSON object for each row; < is escaped so that the text may stand in HTML."""
    return rows.select(F.regexp_replace(F.to_json(F.struct(*rows.columns)), "<", "\\\\u003c").alias("line"))


def write_lines(rows: DataFrame, path: str) -> None:
    ordered = rows.orderBy("seq") if "seq" in rows.columns else rows
    ordered.select("line").write.mode("overwrite").text(path)


def write_connection_csv(status: DataFrame, path: str) -> None:
    """source, dest, widths and status without quoting."""
    line = F.concat_ws(",", names.port_range(F.col("source_path"), F.col("source_width")), names.port_range(F.col("dest_path"), F.col("dest_width")), "kind", "status")
    status.select(line.alias("line")).write.mode("overwrite").text(path)


#: Lines of one part of a document; parts follow each other in blocks of this many numbers.
_PART = 1 << 40


def document_lines(spark: SparkSession, parts: list[str | tuple[DataFrame, list[str]]]) -> DataFrame:
    """(seq, line) of a JSON document of texts and lists, in order.

    A list is (rows, order): one line for each row, whole, as the executors write it; whatever the
    number of rows, none come to the driver.
    """
    texts = [(k * _PART, x) for k, x in enumerate(parts) if isinstance(x, str)]
    out = spark.createDataFrame(texts, "seq long, line string")
    for k, part in enumerate(parts):
        if not isinstance(part, str):
            rows, order = part
            value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
            lines = ranked(rows.withColumn("_json", value), order).select((F.col("rank") + k * _PART).alias("seq"), F.concat(F.when(F.col("rank") > 1, ",").otherwise(" "), F.col("_json")).alias("line"))
            out = out.unionAll(lines)
    return out.select("seq", F.regexp_replace("line", "<", "\\\\u003c").alias("line"))


def _port_of(issues: DataFrame) -> Column:
    return names.full_path(F.col("instance"), F.col("port"))


def connection_report_lines(top: str, status: DataFrame, issues: DataFrame, waived: DataFrame, health: DataFrame, pairs: DataFrame, risks: DataFrame, ports: DataFrame) -> DataFrame:
    """The whole connectivity report: counts, every issue, module, coupling, risk and connection.

    ``read_baseline(..., lines=True)`` reads the connections back.
    """
    spark = status.sparkSession
    n = status.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    counts = issues.agg(*[F.count_if(F.col("severity") == s).alias(k) for s, k in (("ERROR", "errors"), ("WARN", "warnings"), ("INFO", "info"))]).first().asDict()
    extra = [c for c in ("line", "col") if c in issues.columns]
    listed = issues.select("type", "severity", _port_of(issues).alias("port"), "source", "dest", "detail", *extra)
    score = health.agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("s")).first()["s"]
    summary = {"connections_analyzed": n, **counts, "waived": waived.count()}
    analysis = {"overall_score": round(score, 2), "total_ports": ports.count(), "total_connections": n, "total_issues": sum(counts.values())}
    modules = health.select(F.col("instance_path").alias("instance"), names.short_name(F.col("instance_path")).alias("name"), F.col("n_ports").alias("total_ports"), F.col("n_connected").alias("connected"), F.col("n_error").alias("errors"), F.col("n_warn").alias("warnings"), F.round("score", 2).alias("score"))
    coupled = pairs.select(F.col("source_instance").alias("source"), F.col("dest_instance").alias("dest"), F.col("n_links").alias("connections"))
    risky = risks.select("level", "type", _port_of(risks).alias("port"), F.col("detail").alias("reason"))
    ended = status.select(names.port_range(F.col("source_path"), F.col("source_width")).alias("source"), names.port_range(F.col("dest_path"), F.col("dest_width")).alias("dest"), "status")
    head = json.dumps({"version": "1.0", "top": top, "summary": summary})[:-1]
    return document_lines(
        spark,
        [f'{head}, "issues": [', (listed, ["type", "port", "source", "dest", "detail"]), f'], "analysis": {json.dumps(analysis)[:-1]}, "module_health": [', (modules, ["score", "instance"]), '], "coupling": [', (coupled, ["source", "dest"]), '], "risks": [', (risky, ["level", "type", "port", "reason"]), ']}, "connections": [', (ended, ["source", "dest", "status"]), "]}"],
    )


def crossing_report_lines(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """The whole crossing report: counts, domains (name, source) and every crossing (with its id)."""
    counts = {r["category"]: r["n"] for r in rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = {k: counts.get(c, 0) for c, k in (("VIOLATION", "violations"), ("CAUTION", "cautions"), ("CONVENTION", "conventions"), ("INFO", "info"), ("WAIVED", "waived"))}
    listed = rows.select("id", F.col("source_signal").alias("source"), F.col("dest_signal").alias("dest"), "source_domain", "dest_domain", F.array("source_signal", "dest_signal").alias("path"), "category", "severity", "sync_type", "rule", "recommendation", "relationship", "waive_reason", "timing_basis_ns")
    return document_lines(rows.sparkSession, [f'{{"summary": {json.dumps(summary)}, "domains": [', (domains.select("name", "source").distinct(), ["name", "source"]), '], "crossings": [', (listed, ["source", "dest", "id"]), "]}"])


def metrics_report_lines(totals: DataFrame, roots: DataFrame, groups: DataFrame | None = None, cone: DataFrame | None = None, diff: DataFrame | None = None) -> DataFrame:
    """The whole metrics report: totals and every root; on request groups, cone details and a baseline's diff."""
    parts: list = [f'{{"totals": {json.dumps(totals.first().asDict())}, "roots": [', (roots, ["root_kind", "root_id"])]
    for name, rows, order in (("groups", groups, ["signature"]), ("cone_detail", cone, ["root_kind", "root_id", "depth", "node_id"]), ("baseline_diff", diff, ["root_kind", "root_id"])):
        if rows is not None:
            parts += [f'], "{name}": [', (rows, order)]
    return document_lines(roots.sparkSession, [*parts, "]}"])


def combined_summary(top: str, folder: str, exits: dict[str, int], files: list[str], filelists: list[str], formats: dict[str, str]) -> str:
    """The summary of a run of all three modes (exits of conn, cdc and metrics)."""
    status = {f"{m}_status": "ok" if exits[m] == 0 else "issues" for m in MODES}
    paths = {m: f"{folder}/{m}" for m in MODES}
    reports = {"connect_report": f"{folder}/conn/connect_report.json", "cdc_report": f"{folder}/cdc/cdc_report.json", "metrics_report": f"{folder}/metrics/metrics_report.json"}
    head = {"mode": "all", "top": top, **{f"{m}_format": f for m, f in formats.items()}, "used_filelist": bool(filelists)}
    return json.dumps(head | {f"{m}_exit_code": exits[m] for m in MODES} | {"exit_code": max(exits.values()), "source_file_count": len(files)} | status | {"filelists": filelists, "source_files": files, "outputs": paths, "reports": reports}, indent=2)


def interface_lines(interfaces: DataFrame) -> DataFrame:
    """A line for each interface that ``connect.classify_interfaces`` finds."""
    text = F.format_string("  %-16s: %s %s (%d signals, prefix: %s)", names.short_name(F.col("instance_path")), F.col("protocol"), F.col("role"), F.size("matched"), F.col("prefix"))
    return ranked(interfaces, ["instance_path", "protocol"], name="seq").select("seq", text.alias("line"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """Added, removed and changed connections, then their numbers."""
    change, ends = F.col("change"), F.format_string("%s -> %s", "source", "dest")
    text = F.when(change == "added", F.format_string("  + added:   %s  [%s]", ends, F.col("new_status"))).when(change == "removed", F.format_string("  - removed: %s  [was: %s]", ends, F.col("old_status"))).otherwise(F.format_string("  ~ changed: %s  status: %s -> %s", ends, F.col("old_status"), F.col("new_status")))
    order = F.when(change == "added", 0).when(change == "removed", 1).otherwise(2)
    body = ranked(diff.withColumn("_k", order), ["_k", "source", "dest", "old_status", "new_status"], name="seq").select("seq", text.alias("line"))
    total = diff.agg(*[F.count_if(change == c).alias(c) for c in ("added", "removed", "changed")])
    none = (F.col("added") + F.col("removed") + F.col("changed")) == 0
    return body.unionAll(total.select(F.lit(_PART).alias("seq"), F.when(none, "no connectivity changes").otherwise(F.format_string("  total: +%d -%d ~%d", "added", "removed", "changed")).alias("line")))


def topology_lines(topology: DataFrame, bare: DataFrame) -> DataFrame:
    """Instances by clock and by reset net (a line for each), then instances with a clock and no reset (bare)."""
    leaf = names.short_name(F.col("instance_path"))
    nets = ranked(topology.distinct(), ["kind", "net", "instance_path"], name="seq").select("seq", F.format_string("%s %s -> %s", "kind", "net", leaf).alias("line"))
    lone = ranked(bare.select("instance_path"), ["instance_path"], name="seq").select((F.col("seq") + _PART).alias("seq"), F.format_string("warning: %s (%s) has a clock and no reset", F.col("instance_path"), leaf).alias("line"))
    return nets.unionAll(lone)


def trace_lines(hops: DataFrame) -> DataFrame:
    """The links of ``connect.trace``, indented by their depth."""
    text = F.concat(F.expr("repeat('  ', depth + 1)"), F.col("source_path"), F.lit(" -> "), F.col("dest_path"))
    return ranked(hops, ["depth", "source_path", "dest_path"], name="seq").select("seq", text.alias("line"))


def markdown_lines(rows: DataFrame, title: str) -> DataFrame:
    head = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(rows.columns) + " |"), (3, "|" + " - |" * len(rows.columns))], "seq long, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    return head.unionAll(rows.select((F.monotonically_increasing_id() + 4).alias("seq"), cells.alias("line")))


def table_text(health: DataFrame, risks: DataFrame, pairs: DataFrame, top: int = 5, width: int = 20) -> str:
    """Health bars, risks by level and the strongest couplings, for a terminal."""
    out = ["Module health"]
    for r in health.limit(top).collect():
        full = round(r["score"] * width)
        out.append(f"  {r['instance_path']:<30} [{'#' * full}{'.' * (width - full)}] {r['score']:.2f}")
    out.append("Risks")
    out += [f"  {r['level']:<7} {r['n']}" for r in risks.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect()]
    out.append("Coupling")
    out += [f"  {r['source_instance']} -> {r['dest_instance']}: {r['n_links']}" for r in pairs.limit(top).collect()]
    return "\n".join(out)


_COLOURS = {"ERROR": "red", "WARN": "orange", "INFO": "blue"}


def dot_lines(connections: DataFrame, issues: DataFrame) -> DataFrame:
    """Instances as nodes, one edge for each pair with its links and the colour of its worst issue."""
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    worst = issues.where("source IS NOT NULL").groupBy(F.col("source").alias("source_path"), F.col("dest").alias("dest_path")).agg(F.min(rank).alias("rank"))
    pairs = connections.join(worst, ["source_path", "dest_path"], "left").groupBy("source_instance", "dest_instance").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    colour = F.when(F.col("rank") == 0, _COLOURS["ERROR"]).when(F.col("rank") == 1, _COLOURS["WARN"]).when(F.col("rank") == 2, _COLOURS["INFO"]).otherwise("black")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', '\\\\"'), F.lit('"'))
    edge = F.concat(F.lit("  "), quoted("source_instance"), F.lit(" -> "), quoted("dest_instance"), F.format_string(' [label="%d", color=%s];', F.col("n"), colour))
    return _framed(pairs.select(edge.alias("line")), "digraph design {", "}")


def crossing_dot_lines(rows: DataFrame) -> DataFrame:
    colour = F.when(F.col("category") == "VIOLATION", "red").when(F.col("category") == "CAUTION", "orange").otherwise("green")
    pairs = rows.groupBy("source_domain", "dest_domain", colour.alias("colour")).agg(F.count(F.lit(1)).alias("n"))
    return _framed(pairs.select(F.format_string('  "%s" -> "%s" [label="%d", color=%s];', "source_domain", "dest_domain", "n", "colour").alias("line")), "digraph crossings {", "}")


def _framed(rows: DataFrame, head: str, tail: str) -> DataFrame:
    spark = rows.sparkSession
    ends = spark.createDataFrame([(-1, head), (1 << 62, tail)], "seq long, line string")
    return ends.unionAll(rows.select(F.monotonically_increasing_id().alias("seq"), "line"))


def html_page(title: str, report: str) -> str:
    """A page that shows a JSON report; the data stands in it with < escaped."""
    data = report.replace("<", "\\u003c")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><pre id=report></pre><script>const data = {data}; document.getElementById('report').textContent = JSON.stringify(data, null, 2);</script>"


def _cells() -> Column:
    return F.format_string(" -from [get_cells {%s}] -to [get_cells {%s}]", "source_signal", "dest_signal")


def sdc_lines(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """A constraint for each crossing (with id): false paths for waived and unsynchronized ones, else a maximum delay.

    periods has domain and period_ns of destination domains.
    """
    timed = rows.join(periods.select(F.col("domain").alias("dest_domain"), F.col("period_ns").cast("string").alias("period")), "dest_domain", "left")
    period = F.coalesce("period", F.lit(DEFAULT_PERIOD))
    line = (
        F.when(F.col("category") == "WAIVED", F.concat(F.lit("set_false_path"), _cells(), F.lit("  ;# waived: "), F.col("id")))
        .when(F.col("sync_type") != "none", F.concat(F.lit("set_max_delay "), period, _cells(), F.lit("  ;# synchronized: "), F.col("id")))
        .otherwise(F.concat(F.lit("set_false_path"), _cells(), F.lit("  ;# needs a synchronizer: "), F.col("id")))
    )
    return timed.select("id", line.alias("line"))


def property_names(ids: DataFrame) -> DataFrame:
    """(id, name): ids as identifiers, repeated ones told apart by _dup and a number."""
    from pyspark.sql import Window

    clean = F.regexp_replace("id", "[^A-Za-z0-9_]", "_")
    k = F.row_number().over(Window.partitionBy("clean").orderBy("id"))
    rows = ids.select("id", clean.alias("clean")).withColumn("k", k)
    return rows.select("id", F.when(F.col("k") == 1, F.col("clean")).otherwise(F.concat("clean", F.lit("_dup"), (F.col("k") - 1).cast("string"))).alias("name"))


def sva_lines(rows: DataFrame) -> DataFrame:
    """An assertion for each crossing that needs attention: its data stay stable when the destination samples."""
    named = rows.where("category IN ('VIOLATION', 'CAUTION')").join(property_names(rows.select("id")), "id")
    return named.select("id", F.format_string("property p_%s; @(posedge %s) $stable(%s); endproperty", "name", F.substring_index("dest_domain", ":", 1), "source_signal").alias("line"))


def waiver_template(rows: DataFrame) -> DataFrame:
    """YAML entries WAIVE-001, ... for violations."""
    bad = ranked(rows.where("category = 'VIOLATION'").select("source_signal", "dest_signal"), ["source_signal", "dest_signal"], name="k")
    entry = F.format_string('  - id: WAIVE-%03d\n    crossing: "%s -> %s"\n    reason: "TODO"\n    owner: "TODO"', "k", "source_signal", "dest_signal")
    return bad.select(F.col("k").cast("int").alias("seq"), entry.alias("line"))


MODES = ("conn", "cdc", "metrics")


def exit_code(mode: str, counts: dict[str, int], strict: bool = False, regressions: int = 0, fail_on_regression: bool = False) -> int:
    """Issues up to 255; violations (with cautions if strict) up to 255; 2 for a regression that must fail; "all" is the greatest."""
    if mode == "all":
        return max(exit_code(m, counts, strict, regressions, fail_on_regression) for m in MODES)
    if mode == "conn":
        return min(255, counts.get("issues", 0))
    if mode == "cdc":
        return min(255, counts.get("violation", 0) + (counts.get("caution", 0) if strict else 0))
    return 2 if fail_on_regression and regressions else 0
