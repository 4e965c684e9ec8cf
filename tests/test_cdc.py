from gridweft.operators import cdc

FF = "hier_path string, source_id string, edge string, width int, fanin array<string>, reset_path string, reset_async boolean, seq int"
EDGE = "src_path string, dst_path string, has_comb boolean, seq int"


def run(spark, ffs, edges, relations=(), false_paths=(), stages=2, gated=()):
    regs = spark.createDataFrame([(p, s, "pos", w, f, r, r is not None, k) for k, (p, s, w, f, r) in enumerate(ffs)], FF)
    conn = spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], EDGE)
    ids = sorted({f[1] for f in ffs})
    sources = spark.createDataFrame([(s, s, s, None, 10.0, k) for k, s in enumerate(ids)], "source_id string, name string, origin_signal string, master_id string, period_ns double, seq int")
    rel = spark.createDataFrame([(*r, k) for k, r in enumerate(relations)], "a_id string, b_id string, relationship string, sdc_declared boolean, seq int")
    false = spark.createDataFrame(list(false_paths), "from_clk string, to_clk string")
    gate = spark.createDataFrame([(g,) for g in gated], "source_id string")
    found = cdc.detect_crossings(conn, regs, sources, rel, false, gate)
    return sorted((r.category, r.rule, r.sync_type) for r in cdc.verify(found, regs, conn, sources, stages).collect())


A, B = ("m.q_a", "clk_a", 1, ["data_in"], None), ("m.q_b", "clk_b", 1, ["q_a"], None)


def test_missing_synchronizer(spark):
    assert run(spark, [A, B], [("m.q_a", "m.q_b", False)]) == [("VIOLATION", "Ac_cdc01", "none")]


def test_same_domain_is_no_crossing(spark):
    assert run(spark, [A, ("m.q_b", "clk_a", 1, ["q_a"], None)], [("m.q_a", "m.q_b", False)]) == []


def test_two_and_three_registers(spark):
    ffs = [A, B, ("m.s2", "clk_b", 1, ["q_b"], None)]
    edges = [("m.q_a", "m.q_b", False), ("m.q_b", "m.s2", False)]
    assert run(spark, ffs, edges) == [("INFO", "Ac_cdc01", "two_ff")]
    assert run(spark, ffs, edges, stages=3) == [("CAUTION", "Ac_cdc01", "two_ff")]
    more = [*ffs, ("m.s3", "clk_b", 1, ["s2"], None)]
    assert run(spark, more, [*edges, ("m.s2", "m.s3", False)]) == [("INFO", "Ac_cdc01", "three_ff")]


def test_logic_before_synchronizer(spark):
    assert run(spark, [A, B, ("m.s2", "clk_b", 1, ["q_b"], None)], [("m.q_a", "m.q_b", True), ("m.q_b", "m.s2", False)]) == [("CAUTION", "Ac_cdc02", "two_ff")]


def test_constraints(spark):
    edge = [("m.q_a", "m.q_b", False)]
    assert run(spark, [A, B], edge, false_paths=[("clk_a", "clk_b")])[0][0] == "INFO"
    assert run(spark, [A, B], edge, relations=[("clk_b", "clk_a", "PhysicallyExclusive", True)])[0][0] == "INFO"
    assert run(spark, [A, B], edge, relations=[("clk_a", "clk_b", "Divided", False)])[0][0] == "CAUTION"
    assert run(spark, [A, B], edge, relations=[("clk_a", "clk_b", "Divided", False)], gated=["clk_b"])[0][0] == "INFO"


def test_handshake(spark):
    ffs = [("m.req", "a", 1, ["x"], None), ("m.r1", "b", 1, ["req"], None), ("m.r2", "b", 1, ["r1"], None), ("m.ack", "b", 1, ["y"], None), ("m.k1", "a", 1, ["ack"], None), ("m.k2", "a", 1, ["k1"], None)]
    edges = [("m.req", "m.r1", False), ("m.r1", "m.r2", False), ("m.ack", "m.k1", False), ("m.k1", "m.k2", False)]
    assert run(spark, ffs, edges) == [("INFO", "Ac_cdc01", "handshake")] * 2


def test_wide_bus_and_reset(spark):
    wide = [("m.data", "a", 8, ["x"], None), ("m.b1", "b", 8, ["data"], None), ("m.b2", "b", 8, ["b1"], None)]
    edges = [("m.data", "m.b1", False), ("m.b1", "m.b2", False)]
    assert run(spark, wide, edges) == [("CAUTION", "Ac_cdc04", "two_ff")]
    reset = [("m.rst_q", "a", 1, ["x"], None), ("m.d", "b", 1, ["y"], "m.rst_q")]
    assert run(spark, reset, []) == [("CAUTION", "Ac_cdc06", "none")]


def test_clock_as_data_many_domains_and_static(spark):
    assert ("CAUTION", "Ac_cdc09", "none") in run(spark, [("m.a", "clk_a", 1, ["clk_b"], None), ("m.b", "clk_b", 1, ["x"], None)], [])
    three = [("m.s", "a", 1, ["x"], None), ("m.b1", "b", 1, ["s"], None), ("m.b2", "b", 1, ["b1"], None), ("m.c1", "c", 1, ["s"], None), ("m.c2", "c", 1, ["c1"], None)]
    edges = [("m.s", "m.b1", False), ("m.b1", "m.b2", False), ("m.s", "m.c1", False), ("m.c1", "m.c2", False)]
    assert {x[0] for x in run(spark, three, edges)} == {"CAUTION"}
    assert run(spark, [("m.cfg_a", "a", 1, ["x"], None), B], [("m.cfg_a", "m.q_b", False)]) == [("INFO", "Ac_cdc12", "none"), ("VIOLATION", "Ac_cdc01", "none")]


def test_gray_pointers_johnson_and_depth(spark):
    def pointers(n, fanin):
        ffs, edges = [], []
        for k in range(n):
            ffs += [(f"m.wptr{k}", "a", 1, fanin, None), (f"m.x{k}a", "b", 1, [f"wptr{k}"], None), (f"m.x{k}b", "b", 1, [f"x{k}a"], None)]
            edges += [(f"m.wptr{k}", f"m.x{k}a", False), (f"m.x{k}a", f"m.x{k}b", False)]
        return ffs, edges

    assert {x[2] for x in run(spark, *pointers(3, ["i"]))} == {"async_fifo"}
    assert {x[1] for x in run(spark, *pointers(3, ["depth"]))} == {"Ac_cdc07"}
    assert {(x[0], x[2]) for x in run(spark, *pointers(4, ["wptr1"]))} == {("INFO", "johnson_counter")}


def test_waivers_and_relations(spark):
    regs = spark.createDataFrame([(p, s, "pos", w, f, r, False, k) for k, (p, s, w, f, r) in enumerate([A, B])], FF)
    conn = spark.createDataFrame([("m.q_a", "m.q_b", False, 0)], EDGE)
    sources = spark.createDataFrame([("clk_a", "clk_a", "clk_a", None, None), ("clk_b", "clk_b", "clk_b", "clk_a", None)], "source_id string, name string, origin_signal string, master_id string, period_ns double")
    none = spark.createDataFrame([], "a_id string, b_id string, relationship string, sdc_declared boolean, seq int")
    found = cdc.detect_crossings(conn, regs, sources, none, spark.createDataFrame([], "from_clk string, to_clk string"), spark.createDataFrame([], "source_id string"))
    rules = spark.createDataFrame([("W", "m.q_a -> m.q_b", "", "ok", "", "", 0)], "id string, crossing string, pattern string, reason string, owner string, date string, seq int")
    assert [(r.category, r.waive_reason) for r in cdc.apply_cdc_waivers(found, rules).collect()] == [("WAIVED", "ok")]
    assert [(r.a_id, r.b_id, r.relationship) for r in cdc.inferred_relations(sources, none).collect()] == [("clk_a", "clk_b", "Divided")]
    groups = spark.createDataFrame([(0, "Asynchronous", 0, "clk_a"), (0, "Asynchronous", 1, "clk_b"), (1, "LogicallyExclusive", 0, "clk_b")], "stmt int, kind string, group_no int, clock string")
    assert {(r.a_id, r.b_id, r.relationship) for r in cdc.declared_relations(groups, sources).collect()} == {("clk_a", "clk_b", "Asynchronous"), ("clk_b", "clk_a", "LogicallyExclusive")}
