import pytest

from gridweft.operators import connect, elaborate
from gridweft.sources import rtl

DESIGN = """
`define WIDE 8
module chain #(parameter N = `WIDE) (input logic clk, input logic d, output logic [N-1:0] o, output logic q);
  logic m; // "quoted"
  always_ff @(posedge clk) begin m <= d; q <= m; end
  assign o = '0;
endmodule
module chip (input clk_a, clk_b, rst_n, input logic signed [7:0] din, output logic [3:0] y);
`ifdef NEVER
  broken broken broken
`else
  wire mixed; reg [7:0] held; logic plain, safe;
`endif
  assign mixed = held[0] & din[1];
  assign {plain, y} = {safe, din[3:0]};
  always @(posedge clk_a or negedge rst_n)
    if (!rst_n) held <= 8'b0; else held <= din;
  logic late; // behind logic
  always_ff @(posedge clk_b) case (din) 1: late <= mixed; default: late <= 1'b0; endcase
  chain u_s (.clk(clk_b), .d(held), .o(), .q(safe));
  chain u_t (clk_a, 1'b0, , );
  generate for (genvar i = 0; i < 2; i++) begin : g
    logic r;
    always_ff @(posedge clk_a) r <= held[i];
  end endgenerate
endmodule
"""


@pytest.fixture(scope="module")
def facts(spark):
    texts = spark.createDataFrame([("a.sv", DESIGN), ("b.sv", None), ("c.sv", ""), ("d.sv", "module half (input a")], "file string, text string")
    return rtl.statements(texts).persist()


def test_statements(facts):
    odd = [r.name for r in facts.where("kind = 'unsupported'").collect()]
    assert len(odd) == 1 and odd[0].startswith("unreadable")
    found = {(r.module, r.name): (r.direction, r.width, r.is_signed) for r in facts.where("kind = 'port'").collect()}
    assert found["chain", "o"] == ("Out", 8, False) and found["chip", "din"] == ("In", 8, True) and found["chip", "clk_b"] == ("In", 1, False)
    registers = {r.name: (r.clock, r.edge, r.reset, r.refs) for r in facts.where("kind = 'register' AND module = 'chip'").collect()}
    assert registers == {"held": ("clk_a", "pos", "rst_n", ["din"]), "late": ("clk_b", "pos", None, ["mixed"]), "g[0].r": ("clk_a", "pos", None, ["held"]), "g[1].r": ("clk_a", "pos", None, ["held"])}
    assigned = {r.name: (r.refs, r.op) for r in facts.where("kind = 'assign' AND module = 'chip'").collect()}
    assert assigned["plain"] == (["safe"], "alias") and assigned["y"] == (["din"], "alias") and assigned["mixed"] == (["held", "din"], "binary")


def test_elaboration_and_links(facts):
    tree = elaborate.instance_tree(facts, "chip")
    assert sorted((r.path, r.module, r.depth) for r in tree.collect()) == [("chip", "chip", 0), ("chip.u_s", "chain", 1), ("chip.u_t", "chain", 1)]
    assert elaborate.instance_tree(facts, "chip", 0).count() == 1 and elaborate.instance_tree(facts, "absent").count() == 0
    ports = elaborate.ports(facts, tree)
    state = {r.full_path: (r.connected, r.tie_off, r.tie_zero) for r in elaborate.port_state(facts, tree, ports).collect()}
    assert state["chip.u_s.o"] == (False, False, False) and state["chip.u_t.d"] == (True, True, True) and state["chip.u_t.clk"] == (True, False, False)
    bound = elaborate.port_bindings(facts, tree, ports)
    assert ("chip.u_s", "q", "chip.safe", True) in {(r.instance_path, r.port_name, r.net_key, r.is_driver) for r in bound.collect()}
    aliases = elaborate.net_aliases(elaborate.assigns(facts, tree))
    assert ("chip.plain", "chip.safe", False) in {(r.lhs_key, r.rhs_key, r.approximate) for r in aliases.collect()}
    connect.build_connections(ports, bound, aliases).collect()


def test_crossings_from_source(facts):
    found = {(r.source_signal, r.dest_signal): (r.category, r.sync_type, r.rule) for r in elaborate.crossings(facts, "chip").collect()}
    assert set(found) == {("chip.held", "chip.late"), ("chip.held", "chip.u_s.m")}
    assert found["chip.held", "chip.late"][0] == "CAUTION" and found["chip.held", "chip.late"][2] == "Ac_cdc02"
    assert found["chip.held", "chip.u_s.m"][1] == "two_ff"


def test_wildcards_bind_what_is_not_listed(spark):
    text = "module k (input a, b, output c); endmodule module t; wire a, b, z; k u (.c(z), .*); endmodule"
    facts = rtl.statements(spark.createDataFrame([("x", text)], "file string, text string"))
    tree = elaborate.instance_tree(facts, "t")
    bound = elaborate.port_bindings(facts, tree, elaborate.ports(facts, tree))
    assert sorted((r.port_name, r.net_key, r.is_driver) for r in bound.collect()) == [("a", "t.a", False), ("b", "t.b", False), ("c", "t.z", True)]


def test_types_that_stand_in_place():
    rows = rtl.parse("x", "module t (output o); enum logic {IDLE, BUSY} now, next; assign o = (now == IDLE); endmodule")
    assert [(r["kind"], r["name"]) for r in rows if r["kind"] != "port"] == [("module", "t"), ("net", "now"), ("net", "next"), ("assign", "o")]
    assert rows[-1]["refs"] == ["now"]


def test_unnamed_clocks_and_names_through_instances(spark):
    text = """module low (input c, d); for (genvar i = 0; i < 2; i = i + 1) begin : g logic r; always_ff @(posedge c) r <= d; end endmodule
module high (input tick, tock, d); logic s; low u (.c(tick), .d(d)); always_ff @(posedge tock) s <= u.g[1 - 1].r; endmodule"""
    facts = rtl.statements(spark.createDataFrame([("x", text)], "file string, text string"))
    assert [(r.source_signal, r.dest_signal, r.category, r.source_domain, r.dest_domain) for r in elaborate.crossings(facts, "high").collect()] == [("high.u.g[0].r", "high.s", "VIOLATION", "net_high.tick:pos", "net_high.tock:pos")]


def test_a_module_in_itself_ends(spark):
    facts = rtl.statements(spark.createDataFrame([("x", "module a; a u (); endmodule")], "file string, text string"))
    assert elaborate.instance_tree(facts, "a", 2).count() == 3
