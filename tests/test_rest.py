import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gridweft.operators import convention, metrics
from gridweft.plans import ORACLE_SQL, QUERIES
from gridweft.sinks import reports
from gridweft.sources import facts, filelist, rules, sdc

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def test_sdc():
    text = """# comment
create_clock -name clk_a -period 10 [get_ports clk_a]
create_generated_clock -name div2 -source [get_ports clk_a] \\
  -divide_by 2 [get_pins u/q]
set_clock_groups -physically_exclusive -group {clk_a div2} -group [get_clocks clk_b]
set_false_path -from [get_clocks clk_a] -to [get_clocks clk_b]
set_max_delay 5 -from a -to b
set_unknown x"""
    found = sdc.parse_sdc(text)
    assert found.clocks == [("clk_a", 10.0, "clk_a")]
    assert found.generated == [("div2", "clk_a", "u/q", 2, 1, False)]
    assert found.groups == [(0, "PhysicallyExclusive", 0, "clk_a"), (0, "PhysicallyExclusive", 0, "div2"), (0, "PhysicallyExclusive", 1, "clk_b")]
    assert found.false_paths == [("clk_a", "clk_b")] and found.max_delays == [(5.0, "a", "b")]
    assert sdc.parse_sdc("create_clock -period bad x").clocks == [("", None, "x")]


def test_filelist(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.f").write_text("deep.sv\n")
    (tmp_path / "top.f").write_text("+incdir+inc // c\n+define+X=1\na.sv # c\n-F sub/n.f\n-y lib\n")
    found = filelist.parse_filelist(str(tmp_path / "top.f"))
    assert found.sources == [str(tmp_path / "a.sv"), str(tmp_path / "sub" / "deep.sv")]
    assert found.defines == ["X=1"] and found.include_dirs == [str(tmp_path / "inc")] and not found.problems
    (tmp_path / "loop.f").write_text("-F loop.f\n")
    assert filelist.parse_filelist(str(tmp_path / "loop.f")).problems


def test_yaml(spark):
    assert rules.conn_waivers(spark, "waivers:\n - {pattern: 'a.*'}\n").first().type == "*"
    with pytest.warns(UserWarning):
        assert rules.conn_waivers(spark, "a: [").count() == 0
    assert rules.cdc_waivers(spark, "waivers:\n - {id: W, pattern: 'x*'}\n - {pattern: y}\n").count() == 1
    assert rules.expectations(spark, "expected:\n - {from: a, to: b}\nforbidden: []").count() == 1
    r = rules.convention_rules("input_suffixes: '_i, _pi'\nmax_line_length: bad\nprohibit_tabs: true")
    assert r.input_suffixes == ["_i", "_pi"] and r.max_line_length == 0 and r.prohibit_tabs
    assert rules.period_ns("100MHz") == 10.0 and rules.period_ns("x") is None
    clocks, pairs = rules.clock_rules(spark, "clock_sources:\n - {name: a, frequency: 1GHz}\ndomain_groups:\n - {type: Divided, clocks: [a, b, c]}")
    assert clocks.first().period_ns == 1.0 and pairs.count() == 3


def test_source_lines(spark):
    texts = spark.createDataFrame([("f", "ok\n\tx \ny \r\n" + "é" * 6 + "\nz\t")], "file string, text string")
    found = convention.check_lines(convention.lines_of(texts), convention.Rules(max_line_length=10, prohibit_tabs=True, prohibit_trailing_blanks=True))
    assert sorted((r.rule, r.line_no, r.column) for r in found.collect()) == [("hard_tab", 2, 1), ("hard_tab", 5, 2), ("line_too_long", 4, 11), ("trailing_whitespace", 2, 3), ("trailing_whitespace", 3, 2)]


def test_cones_cycles_slices_and_paths(spark):
    nodes = spark.createDataFrame([(1, "Add", "", "y", ["a", "b"], 8, False), (2, "Mux", "", "a", ["y", "q"], 8, True), (3, "Slice", "", "b[3:0]", ["c"], 4, False), (4, "Slice", "", "b[7:4]", ["d"], 4, False)], "node_id long, op_kind string, op_detail string, output string, inputs array<string>, bit_width int, approximate boolean")
    roots = spark.createDataFrame([("r", "ff_d", "y")], "root_id string, root_kind string, signal string")
    cone, signals = metrics.cones(nodes, roots)
    assert {r.node_id: r.depth for r in cone.collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    s = metrics.cone_summary(cone, signals, nodes).first()
    assert (s.raw, s.n_sources, s.n_approximate) == (4, 3, 1)
    counts, groups = metrics.normalize(cone, nodes)
    assert counts.first().norm == 3 and groups.first().multiplicity == 2
    regs = spark.createDataFrame([("r", "y2", "y"), ("s", "q", "e")], "name string, q_signal string, d_signal string")
    assert [(r.source, r.dest) for r in metrics.ff_paths(cone, nodes, regs).collect()] == [("s", "r")]


def test_reports(spark):
    rows = spark.createDataFrame([("VIOLATION", "a", "b", "x:pos", "none", "V-1"), ("INFO", "c", "d", "y:pos", "two_ff", "I-1")], "category string, source_signal string, dest_signal string, dest_domain string, sync_type string, id string")
    periods = spark.createDataFrame([("y:pos", 4.0)], "domain string, period_ns double")
    lines = {r.id: r.line for r in reports.sdc_lines(rows, periods).collect()}
    assert lines["V-1"].startswith("set_false_path") and lines["I-1"].startswith("set_max_delay 4.0 ")
    assert "WAIVE-001" in reports.waiver_template(rows).first().line
    assert reports.sva_lines(rows).count() == 1
    assert reports.json_lines(spark.createDataFrame([("a<b",)], "x string")).first().line == '{"x":"a\\u003cb"}'
    assert reports.exit_code("cdc", {"violation": 300}) == 255 and reports.exit_code("all", {"issues": 3, "violation": 7}) == 7
    base = spark.createDataFrame([('{"connections":[{"source":"a.p[7:0]","dest":"b.q"},{"source":"","dest":"x"}]}',)], "value string")
    assert [(r.source, r.status) for r in facts.parse_connections(base).collect()] == [("a.p", "OK")]


def whole(lines):
    return json.loads("\n".join(r.line for r in lines.orderBy("seq").collect()))


def test_whole_reports(spark, tmp_path):
    """Reports hold every row, are valid JSON and are read back as baselines."""
    from gridweft.operators import cdc, connect

    rows = [(f"a.o{k}", f"b.i{k}", "a", f"o{k}", "b", f"i{k}", 8, 8 - k % 2, False, False, "Direct") for k in range(1500)]
    links = spark.createDataFrame(rows, "source_path string, dest_path string, source_instance string, source_port string, dest_instance string, dest_port string, source_width int, dest_width int, source_signed boolean, dest_signed boolean, kind string")
    ports = links.select(F.col("source_instance").alias("instance_path"), F.col("source_path").alias("full_path"), F.lit(False).alias("is_top")).unionAll(links.select("dest_instance", "dest_path", F.lit(False)))
    issues = connect.run_checks([connect.check_width(links)])
    status = connect.connection_status(links, issues)
    health = connect.module_health(ports, links, issues)
    lines = reports.connection_report_lines("top", status, issues, issues.limit(0), health, connect.coupling(links), connect.risks(issues), ports)
    found = whole(lines)
    assert found["summary"] == {"connections_analyzed": 1500, "errors": 750, "warnings": 0, "info": 0, "waived": 0}
    assert len(found["connections"]) == 1500 and len(found["issues"]) == 750 and len(found["analysis"]["risks"]) == 750
    assert [m["instance"] for m in found["analysis"]["module_health"]] == ["b", "a"] and found["analysis"]["coupling"] == [{"source": "a", "dest": "b", "connections": 1500}]
    reports.write_lines(lines, str(tmp_path / "report"))
    back = facts.read_baseline(spark, str(tmp_path / "report"), lines=True)
    assert sorted(tuple(r) for r in back.select("source", "dest", "status").collect()) == sorted((r[0], r[1], "WIDTH_MISMATCH" if k % 2 else "OK") for k, r in enumerate(rows))
    now = status.select(F.col("source_path").alias("source"), F.col("dest_path").alias("dest"), "status", F.lit(0).alias("seq"))
    assert [r.line for r in reports.diff_lines(connect.diff_connections(back, now)).collect()] == ["no connectivity changes"]
    text = [r.line for r in reports.diff_lines(connect.diff_connections(back.where("source <> 'a.o1'"), now.where("source <> 'a.o2'"))).orderBy("seq").collect()]
    assert text == ["  + added:   a.o1 -> b.i1  [WIDTH_MISMATCH]", "  - removed: a.o2 -> b.i2  [was: OK]", "  total: +1 -1 ~0"]
    assert [r.line for r in reports.trace_lines(connect.trace(links.where("source_path = 'a.o7'"), "a.*")).collect()] == ["  a.o7 -> b.i7"]

    roots = spark.createDataFrame([(f"r{k}", "ff_d", k, 1, k) for k in range(1200)], "root_id string, root_kind string, raw int, depth int, norm int")
    lines = reports.metrics_report_lines(metrics.totals(roots), roots, diff=metrics.diff_metrics(roots, roots))
    found = whole(lines)
    assert len(found["roots"]) == len(found["baseline_diff"]) == 1200
    reports.write_lines(lines, str(tmp_path / "metrics"))
    assert sorted(map(tuple, facts.read_baseline(spark, str(tmp_path / "metrics"), "roots", lines=True).where("raw IS NOT NULL").collect())) == sorted(map(tuple, roots.collect()))

    crossings = spark.createDataFrame([(f"x{k}", f"m.q{k}", f"m.r{k}", "a:pos", "b:pos", "async", "VIOLATION", "high", "none", "Ac_cdc01", "", "", None, None, "none") for k in range(30)], "cid string, source_signal string, dest_signal string, source_domain string, dest_domain string, relationship string, category string, severity string, sync_type string, rule string, subrule string, recommendation string, waive_reason string, timing_basis_ns double, note string")
    found = whole(reports.crossing_report_lines(cdc.numbered(crossings), spark.createDataFrame([("a:pos", "a"), ("b:pos", "b")], "name string, source string")))
    assert found["summary"]["violations"] == 30 and {c["id"] for c in found["crossings"]} == {f"VIOLATION-{k}" for k in range(1, 31)} and len(found["domains"]) == 2
    summary = json.loads(reports.combined_summary("top", "/out", {"conn": 3, "cdc": 0, "metrics": 2}, ["a.sv"], [], {"conn": "json", "cdc": "json"}))
    assert summary["exit_code"] == 3 and summary["cdc_status"] == "ok" and summary["source_file_count"] == 1
    topology = spark.createDataFrame([("clock", "clk", "t.u"), ("reset", "rst", "t.u"), ("clock", "clk", "t.v")], "kind string, net string, instance_path string")
    assert [r.line for r in reports.topology_lines(topology, connect.clocks_without_reset(topology)).orderBy("seq").collect()] == ["clock clk -> u", "clock clk -> v", "reset rst -> u", "warning: t.v (v) has a clock and no reset"]
    faces = spark.createDataFrame([("t.u", "APB", "master", "m_", ["m_psel", "m_pwrite"])], "instance_path string, protocol string, role string, prefix string, matched array<string>")
    assert reports.interface_lines(faces).first().line == "  u               : APB master (2 signals, prefix: m_)"


def test_orders(spark):
    """Operators that promise an order keep it."""
    from gridweft.operators import connect

    schema = "root_id string, root_kind string, raw long"
    rows = [("c", "output", 5), ("a", "ff_d", 5), ("b", "ff_d", 9), ("d", "output", 1)]
    top = metrics.top_roots(spark.createDataFrame(rows, schema).repartition(4), 3).collect()
    assert [(r.root_kind, r.root_id) for r in top] == [("ff_d", "a"), ("ff_d", "b"), ("output", "c")]
    links = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "b"), ("c", "a"), ("a", "a")], "source_instance string, dest_instance string").repartition(4)
    assert [(r.source_instance, r.n_links) for r in connect.coupling(links).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    issues = spark.createDataFrame([("DANGLING_OUTPUT", "WARN", "x", "p", None, None, ""), ("PROTOCOL_INCOMPLETE", "WARN", "y", None, None, None, ""), ("TYPE_MISMATCH", "ERROR", "z", "p", "s", "t", "")], "type string, severity string, instance string, port string, source string, dest string, detail string").repartition(3)
    assert [r.level for r in connect.risks(issues).collect()] == ["HIGH", "MEDIUM", "LOW"]


def test_stream_diff(spark, tmp_path):
    from gridweft.streaming.diff import stream_diff

    schema = "source string, dest string, status string, seq int"
    spark.createDataFrame([("a", "b", "OK", 0), ("n", "m", "OK", 1)], schema).write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a", "b", "OK", 0), ("x", "y", "OK", 1)], schema)
    stream_diff(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.change, r.source) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("added", "n"), ("removed", "x")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)
