from gridweft.operators import clocks


def test_names_resolve_by_the_nearest(spark):
    known = spark.createDataFrame([("top.u.a",), ("top.a",), ("b",), ("top.c",)], "path string")
    wanted = spark.createDataFrame([("top.u", "a"), ("top.v", "a"), ("top.u", "b"), ("top.u", "c[3]"), ("top.u", "zz")], "scope_path string, signal string")
    found = {(r.scope_path, r.signal): r.path for r in clocks.resolve_names(wanted, known).collect()}
    assert found == {("top.u", "a"): "top.u.a", ("top.v", "a"): "top.a", ("top.u", "b"): "b", ("top.u", "c[3]"): "top.c"}


def test_edges_through_assignments_and_loops(spark):
    ffs = spark.createDataFrame([("m.q", ["w"]), ("m.p", ["q"]), ("m.s", ["x"])], "hier_path string, fanin array<string>")
    assigns = spark.createDataFrame([("m.w", ["m.x"], "alias", "assign", 0), ("m.x", ["m.p", "m.w"], "binary", "comb", 1), ("m.x", ["m.q"], "alias", "comb", 2)], "lhs string, rhs array<string>, op string, kind string, seq int")
    assert sorted(map(tuple, clocks.register_edges(ffs, assigns).collect())) == [("m.p", "m.q", True), ("m.p", "m.s", True), ("m.q", "m.p", False)]


def test_edges_however_long_the_way(spark):
    ffs = spark.createDataFrame([("m.q", ["w0"]), ("m.p", ["x"])], "hier_path string, fanin array<string>")
    ways = [(f"m.w{k}", [f"m.w{k + 1}"], "binary" if k == 12 else "alias", "assign", 0) for k in range(14)] + [("m.w14", ["m.p", "m.w3"], "alias", "assign", 0)]
    assigns = spark.createDataFrame(ways, "lhs string, rhs array<string>, op string, kind string, seq int")
    assert [tuple(r) for r in clocks.register_edges(ffs, assigns).collect()] == [("m.p", "m.q", True)]


def test_unified_clocks_and_score(spark):
    port_map = spark.createDataFrame([("top.c", "top.u.clk"), ("top.d", "top.u.x"), ("top.k", "top.v.clk")], "parent_net string, child_net string")
    used = spark.createDataFrame([("top.u.clk",), ("top.v.clk",)], "child_net string")
    nets = spark.createDataFrame([("top.k",)], "hier_path string")
    assert [r.name for r in clocks.unified_clocks(used, port_map, nets).collect()] == ["top.c"]
    found = spark.createDataFrame([("clk_main:pos", "clk_io:pos"), ("x", "y")], "source_domain string, dest_domain string")
    golden = spark.createDataFrame([("main", "io"), ("p", "q")], "source string, dest string")
    assert tuple(clocks.evaluate(found, golden).first()) == (0.5, 0.5)
