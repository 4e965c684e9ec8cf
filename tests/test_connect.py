from gridweft.functions import names
from gridweft.operators import connect as c
from gridweft.operators.graph import components, follow, reach
from pyspark.sql import functions as F

PORT = "instance_path string, port_name string, direction string, width int, is_signed boolean, is_top boolean, full_path string, seq int"


def ports(spark, rows):
    return spark.createDataFrame([(i, p, d, w, s, top, f"{i}.{p}", k) for k, (i, p, d, w, s, top) in enumerate(rows)], PORT)


def bindings(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "instance_path string, port_name string, net_key string, is_driver boolean, kind string, seq int")


def integration(spark):
    p = ports(spark, [("u_core", "o_data", "Out", 32, False, False), ("u_core", "o_coeff", "Out", 16, True, False), ("u_core", "o_debug", "Out", 1, False, False), ("u_bus", "i_data", "In", 16, False, False), ("u_bus", "i_coeff", "In", 16, False, False), ("u_bus", "i_config", "In", 8, False, False)])
    b = bindings(spark, [("u_core", "o_data", "data", True, "Direct"), ("u_bus", "i_data", "data[15:0]", False, "Direct"), ("u_core", "o_coeff", "coeff", True, "Direct"), ("u_bus", "i_coeff", "coeff", False, "Direct")])
    return p, b, c.build_connections(p, b)


def test_integration_design(spark):
    p, b, links = integration(spark)
    assert [(r.source_path, r.dest_path) for r in links.collect()] == [("u_core.o_coeff", "u_bus.i_coeff")]
    assert c.check_width(links).count() == 0
    assert [r.type for r in c.check_type(links).collect()] == ["TYPE_MISMATCH"]
    connected = b.select(F.concat_ws(".", "instance_path", "port_name").alias("full_path"))
    assert [r.port for r in c.check_dangling(p, links, connected).collect()] == ["o_debug"]
    assert [r.port for r in c.check_undriven(p, links, connected).collect()] == ["i_config"]


def test_aliases_join_nets_and_spread_approximation(spark):
    p = ports(spark, [("a", "o", "Out", 8, False, False), ("b", "i", "In", 4, False, False)])
    b = bindings(spark, [("a", "o", "x", True, "Direct"), ("b", "i", "z", False, "Direct")])
    alias = spark.createDataFrame([("x", "y", False, 0), ("y", "z", True, 1)], "lhs_key string, rhs_key string, approximate boolean, seq int")
    assert [r.kind for r in c.build_connections(p, b, alias).collect()] == ["Approximate"]
    exact = alias.withColumn("approximate", F.lit(False))
    links = c.build_connections(p, b, exact)
    assert [(r.severity, r.detail) for r in c.check_width(links).collect()] == [("ERROR", "8 -> 4 bits")]


def test_glob_and_names(spark):
    rows = spark.createDataFrame([("a_b.c", "a_b.*", True), ("aXb.c", "a_b.*", False), ("u[0].x", "u[0].?", True), ("u0.x", "u[0].?", False), ("50%", "50%", True), ("500", "50%", False)], "text string, pattern string, want boolean")
    assert rows.where(names.glob_match(F.col("text"), F.col("pattern")) != F.col("want")).count() == 0
    one = lambda e, v: spark.range(1).select(e(F.lit(v)).alias("x")).first()["x"]
    assert one(names.is_no_connect, "a_NC_b") and not one(names.is_no_connect, "sync")
    assert one(names.is_cdc_clock, "top.sys_ck") and not one(names.is_cdc_clock, "top.lock")
    assert one(names.strip_index, "x[3]") == "x" and one(names.strip_index, "x3") == "x"
    assert names.safe_pattern("[a-z]+") and not names.safe_pattern("(a+)+") and not names.safe_pattern("a" * 300)
    star = spark.createDataFrame([("abc", "ab*", True), ("abc", "ab", False), ("a*", "a*", True)], "t string, p string, w boolean")
    assert star.where(names.trailing_star_match(F.col("t"), F.col("p")) != F.col("w")).count() == 0


def test_protocol_and_interface(spark):
    lacking = ports(spark, [("u", f"s_{s}", "In", 1, False, False) for s in ("tvalid", "tdata")] + [("w", f"m_{s}", "Out", 1, False, False) for s in ("psel", "penable", "pwrite", "paddr", "pwdata")])
    assert {(r.instance, r.detail) for r in c.check_protocol(lacking).collect()} == {("u", "AXI-Stream data lacks TREADY"), ("w", "APB main lacks PRDATA, PREADY")}
    found = {(r.instance_path, r.protocol, r.role, r.prefix) for r in c.classify_interfaces(lacking).collect()}
    assert found == {("w", "APB", "master", "m_")}


def test_waivers_status_and_diff(spark):
    issues = spark.createDataFrame([("WIDTH_MISMATCH", "ERROR", "u", "p", "a.x", "u.p", "", 0), ("TYPE_MISMATCH", "ERROR", "u", "p", "a.x", "u.p", "", 1)], "type string, severity string, instance string, port string, source string, dest string, detail string, check int")
    rules = spark.createDataFrame([("u.*", "TYPE_MISMATCH", "", "", 0)], "pattern string, type string, reason string, source string, seq int")
    active, waived = c.apply_waivers(issues, rules)
    assert [r.type for r in active.collect()] == ["WIDTH_MISMATCH"] and [r.type for r in waived.collect()] == ["TYPE_MISMATCH"]
    links = spark.createDataFrame([("a.x", "u.p"), ("a.y", "u.q")], "source_path string, dest_path string")
    assert {r.dest_path: r.status for r in c.connection_status(links, issues).collect()} == {"u.p": "WIDTH_MISMATCH", "u.q": "OK"}
    schema = "source string, dest string, status string, seq int"
    base = spark.createDataFrame([("a", "b", "OK", 0), ("a", "b", "ERR", 1), ("x", "y", "OK", 2)], schema)
    now = spark.createDataFrame([("a", "b", "OK", 0), ("n", "m", "OK", 1), ("n", "m", "OK", 2)], schema)
    assert sorted((r.change, r.source) for r in c.diff_connections(base, now).collect()) == [("added", "n"), ("added", "n"), ("changed", "a"), ("removed", "x")]


def test_trace_goes_by_instance_and_ends_in_cycles(spark):
    links = spark.createDataFrame([("a.o", "b.i", "a", "b"), ("b.q", "c.i", "b", "c"), ("c.o", "a.i", "c", "a")], "source_path string, dest_path string, source_instance string, dest_instance string")
    assert sorted((r.depth, r.source_path) for r in c.trace(links, "a.*").collect()) == [(0, "a.o"), (1, "b.q"), (2, "c.o")]
    assert sorted((r.depth, r.source_path) for r in c.trace(links, "a.*", "in").collect()) == [(0, "c.o"), (1, "b.q"), (2, "a.o")]
    assert c.trace(links, "zzz").count() == 0


def test_graph_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a int, b int")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    walk = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    assert {r.node: r.depth for r in reach(walk, spark.createDataFrame([(1,)], "node int"), 10).collect()} == {1: 0, 2: 1, 3: 2}
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "node string, next string")
    assert {r.node: r.root for r in follow(chain).collect()} == dict.fromkeys("abcd", "a")


def test_health_of_nothing_is_one(spark):
    p, _, links = integration(spark)
    issues = c.check_type(links)
    scores = {r.instance_path: round(r.score, 2) for r in c.module_health(p, links, issues).collect()}
    assert scores == {"u_bus": 0.85, "u_core": 1.0}
    assert c.overall_score(c.module_health(p.limit(0), links, issues)).first().score == 1.0
