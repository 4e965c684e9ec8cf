"""Queries of the naming and source-text rules and of baseline parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import convention as v
from gridweft.plans.facts import PORTS, order_ports
from gridweft.plans.registry import query, t
from gridweft.sources.facts import parse_connections, parse_roots
from gridweft.sources.style import style_observations

RULES = v.Rules(clock_pattern="i_clk_.*", reset_pattern="i_rst_n_.*", active_low_suffix="1", lowercase_port_names=True, reject_digit_suffix=True, output_suffixes=["5"], output_prefix="q_", input_prefix="i_d")


@query(
    "c9_port_conventions",
    f"""WITH {PORTS}, p AS (SELECT *, regexp_full_match(port_name, 'i_clk_.*') AS clk, regexp_full_match(port_name, 'i_rst_n_.*') AS rst FROM ports)
SELECT 'lowercase' AS rule, instance_path, port_name AS name FROM p WHERE regexp_matches(port_name, '[A-Z]')
UNION ALL SELECT 'active_low', instance_path, port_name FROM p WHERE direction = 'In' AND port_name LIKE '%1' AND NOT rst AND NOT clk
UNION ALL SELECT 'digit_suffix', instance_path, port_name FROM p WHERE regexp_matches(port_name, '_[0-9]+$')
UNION ALL SELECT 'input_name', instance_path, port_name FROM p WHERE direction = 'In' AND NOT clk AND NOT rst AND port_name NOT LIKE 'i\\_d%' ESCAPE '\\'
UNION ALL SELECT 'output_name', instance_path, port_name FROM p WHERE direction = 'Out' AND port_name NOT LIKE 'q\\_%' ESCAPE '\\' AND port_name NOT LIKE '%5'""",
)
def conventions(spark, d):
    return v.check_ports(order_ports(spark, d), RULES)


@query("c15_instance_prefix", "SELECT 'n' || c_nationkey || '.c' || c_custkey AS instance_path, c_mktsegment AS name FROM customer WHERE c_mktsegment NOT LIKE 'A%'")
def instance_prefix(spark, d):
    cu = t(spark, d, "customer")
    rows = cu.select(F.expr("concat('n', c_nationkey, '.c', c_custkey)").alias("path"), F.col("c_mktsegment").alias("name"), F.expr("concat('n', c_nationkey)").alias("parent_path"))
    return v.check_instances(rows, v.Rules(instance_prefix="A")).select("instance_path", "name")


@query("c16_c17_declarations", "SELECT CASE WHEN p_size % 2 = 0 THEN 'parameter_name' ELSE 'typedef_name' END AS rule, p_brand AS instance_path, p_name AS name FROM part WHERE (p_size % 2 = 0 AND NOT regexp_full_match(p_name, '[a-m].*')) OR (p_size % 2 = 1 AND NOT regexp_matches(p_name, 'e'))")
def declarations(spark, d):
    rows = t(spark, d, "part").select(F.expr("CASE WHEN p_size % 2 = 0 THEN 'parameter' ELSE 'typedef' END").alias("decl_kind"), F.col("p_brand").alias("scope_path"), F.col("p_name").alias("name"))
    return v.check_declarations(rows, v.Rules(parameter_pattern="[a-m].*", typedef_pattern="e"))


@query("c24_missing_d_suffix", "WITH s AS (SELECT user_id, event_type, bool_or(event_id % 3 = 0) AS q, bool_or(event_id % 7 = 1) AS dd FROM events GROUP BY ALL) SELECT 'u' || user_id AS scope_path, event_type AS base FROM s WHERE q AND NOT dd AND user_id % 2 = 0")
def d_suffix(spark, d):
    e = t(spark, d, "events")
    suffix = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("_q"))).otherwise(F.array().cast("array<string>"))
    other = F.when(F.col("event_id") % 7 == 1, F.array(F.lit("_d"))).otherwise(F.array().cast("array<string>"))
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope_path"), "event_type", (F.col("user_id") % 2 == 0).alias("has_comb"), F.explode(F.concat(suffix, other)).alias("s"))
    return v.missing_d_suffix(rows.select("scope_path", F.concat("event_type", "s").alias("name"), "has_comb"))


_LINES = "lines AS (SELECT doc_id::VARCHAR AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"


@query("c29_c30_source_lines", f"WITH {_LINES} SELECT 'line_too_long' AS rule, file, line_no::INT AS line_no, 101 AS column FROM lines WHERE strlen(text) > 100 UNION ALL SELECT 'hard_tab', file, line_no::INT, instr(text, chr(9))::INT FROM lines WHERE contains(text, chr(9)) UNION ALL SELECT 'trailing_whitespace', file, line_no::INT, length(rtrim(text, ' ' || chr(9)))::INT + 1 FROM lines WHERE regexp_matches(text, '[ \\t]$') AND NOT regexp_matches(text, '\\t$')")
def source_lines(spark, d):
    texts = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return v.check_lines(v.lines_of(texts), v.Rules(max_line_length=100, prohibit_tabs=True, prohibit_trailing_blanks=True))


@query("c18_style_observations", "SELECT 'CONVENTION' AS type, 'INFO' AS severity, 'u' || user_id AS instance, CASE WHEN event_id % 4 = 0 THEN '<no-name>' ELSE 'n' || event_id END AS port, event_type AS detail, (event_id % 50)::INT AS line FROM events")
def observations(spark, d):
    e = t(spark, d, "events")
    rows = e.select(F.lit("x").alias("kind"), F.expr("concat('u', user_id)").alias("scope_path"), F.when(F.col("event_id") % 4 != 0, F.expr("concat('n', event_id)")).otherwise("").alias("name"), F.col("event_type").alias("detail"), (F.col("event_id") % 50).cast("int").alias("line"), F.lit(1).alias("col"))
    return v.style_issues(rows).select("type", "severity", "instance", "port", "detail", F.coalesce("line", F.lit(0)).alias("line"))


@query("c14_inout_names", "SELECT 'p' || p_partkey AS name FROM part WHERE p_size % 3 = 0 AND p_partkey % 10 <> 7")
def inout_names(spark, d):
    ports = t(spark, d, "part").select(F.lit("top").alias("instance_path"), F.expr("concat('p', p_partkey)").alias("port_name"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'InOut' ELSE 'In' END").alias("direction"))
    return v.check_ports(ports, v.Rules(input_prefix="", output_prefix="", inout_suffixes=["7"])).select("name")


@query("s21_baseline_roots", "SELECT 'r' || event_id AS root_id, event_type AS root_kind, (event_id % 100)::INT AS raw, (event_id % 7)::INT AS depth, (event_id % 30)::INT AS norm FROM events")
def baseline_roots(spark, d):
    number = lambda n: (F.col("event_id") % n).cast("int")
    roots = F.array(F.struct(F.expr("concat('r', event_id)").alias("root_id"), F.col("event_type").alias("root_kind"), number(100).alias("raw"), number(7).alias("depth"), number(30).alias("norm")))
    return parse_roots(t(spark, d, "events").select(F.to_json(F.struct(roots.alias("roots"))).alias("value")))


@query("c31_files", "WITH f AS (SELECT s_nationkey::VARCHAR || '/' || (min(s_suppkey))::VARCHAR || '.sv' AS file, count(*) AS n, min(s_suppkey)::VARCHAR AS m FROM supplier GROUP BY s_nationkey, s_suppkey % 2) SELECT 'multiple_modules' AS rule, file, n FROM f WHERE n > 1")
def files(spark, d):
    s = t(spark, d, "supplier").withColumn("half", F.col("s_suppkey") % 2)
    least = s.groupBy("s_nationkey", "half").agg(F.min("s_suppkey").alias("m"))
    rows = s.join(least, ["s_nationkey", "half"]).select(F.expr("concat(s_nationkey, '/', m, '.sv')").alias("file"), F.col("s_suppkey").cast("string").alias("module"))
    return v.check_files(rows, v.Rules(one_module_per_file=True, file_module_match=True))


_HREF = 'href="/([A-Za-z]+)"'


@query(
    "g6_module_reachability",
    f"""WITH RECURSIVE m AS (SELECT regexp_extract(url, '([a-z]+)\\.example', 1) AS src, lower(unnest(regexp_extract_all(html, '{_HREF}', 1))) AS dst FROM pages),
e AS (SELECT DISTINCT src, dst FROM m WHERE src <> dst), top AS (SELECT min(src) AS top FROM e), walk(module, depth) AS (SELECT top, 0 FROM top UNION SELECT e.dst, depth + 1 FROM walk JOIN e ON e.src = walk.module WHERE depth < 60)
SELECT module, min(depth)::INT AS depth FROM walk GROUP BY module""",
)
def reachability(spark, d):
    p = t(spark, d, "pages")
    edges = p.select(F.regexp_extract("url", r"([a-z]+)\.example", 1).alias("parent"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("child")).select("parent", F.lower("child").alias("child")).where("parent <> child").distinct()
    top = edges.agg(F.min("parent").alias("m")).first()["m"]
    return v.reachable_modules(edges, top or "")


@query("s20_baseline_connections", """SELECT 's' || user_id AS source, 'k' || json_extract_string(props, '$.k') AS dest, CASE WHEN event_id % 2 = 0 THEN 'OK' ELSE event_type END AS status FROM events""")
def baseline(spark, d):
    e = t(spark, d, "events")
    value = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("[7:0]")).alias("source"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dest"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("status"))).alias("connections")))
    return parse_connections(e.select(value.alias("value"))).select("source", "dest", "status")


_SOURCE = [
    ("'module p' || p_partkey || ' (input clk, input rst, output logic [3:0] y);'"),
    ("CASE WHEN p_partkey % 2 = 0 THEN 'always @(posedge clk) y <= ' || p_size || ';' ELSE 'always_ff @(posedge clk) r_q <= r_d;' END"),
    ("CASE p_partkey % 3 WHEN 0 THEN 'enum {A, B} e' || p_partkey || ';' WHEN 1 THEN 'bit [3:0] b' || p_partkey || ';' ELSE 'logic l;' END"),
    ("CASE WHEN p_partkey % 5 = 0 THEN 'if (1) begin end' ELSE 'if (1) begin : named end' END"),
    ("CASE WHEN p_partkey % 7 = 0 THEN 'leaf u (.*);' ELSE 'leaf u (.a(' || p_size || '));' END"),
    ("CASE WHEN p_partkey % 4 = 0 THEN 'always_comb begin case (y) 1: z_d = 1; endcase end' ELSE 'always_comb unique case (y) 1: z_d = 1; default: z_d = 0; endcase' END"),
    ("CASE p_partkey % 11 WHEN 0 THEN 'always_ff @(posedge clk, negedge rst_n) bare <= 1;' WHEN 1 THEN 'always_ff @(posedge clk or posedge rst) w_q <= 1;' ELSE '' END"),
    "'endmodule'",
]


@query(
    "c19_c28_style_of_sources",
    """WITH p AS (SELECT p_partkey AS k, p_size AS s, 'i' || p_partkey AS i, 'f' || p_partkey AS f FROM part)
SELECT 'LegacyAlwaysBlock' AS kind, i AS scope_path, '' AS name, 2 AS line FROM p WHERE k % 2 = 0
UNION ALL SELECT 'BareIntegerLiteral', f, s::VARCHAR, 2 FROM p WHERE k % 2 = 0 AND s > 1
UNION ALL SELECT 'AnonymousEnum', i, 'e' || k, 3 FROM p WHERE k % 3 = 0
UNION ALL SELECT 'BannedStateType', i, 'b' || k, 3 FROM p WHERE k % 3 = 1
UNION ALL SELECT 'UnnamedGenerateBlock', i, '', 4 FROM p WHERE k % 5 = 0
UNION ALL SELECT 'WildcardPortConnection', f, '.*', 5 FROM p WHERE k % 7 = 0
UNION ALL SELECT 'BareIntegerLiteral', f, s::VARCHAR, 5 FROM p WHERE k % 7 <> 0 AND s > 1
UNION ALL SELECT unnest(['MissingUniqueCase', 'MissingCaseDefault']), i, '', 6 FROM p WHERE k % 4 = 0
UNION ALL SELECT 'ResetPolarityBad', i, CASE WHEN k % 11 = 1 THEN 'rst' ELSE '' END, 7 FROM p WHERE k % 11 < 2
UNION ALL SELECT 'MissingQSuffix', i, 'bare', 7 FROM p WHERE k % 11 = 0
UNION ALL SELECT 'MissingDSuffix', i, 'r_q', 0 FROM p WHERE k % 2 = 1
UNION ALL SELECT 'MissingDSuffix', i, 'w_q', 0 FROM p WHERE k % 11 = 1""",
)
def style_of_sources(spark, d):
    """A module of each part, its source made of the part's columns."""
    p = t(spark, d, "part")
    texts = p.select(F.expr("concat('f', p_partkey)").alias("file"), F.expr("concat_ws('\n', " + ", ".join(_SOURCE) + ")").alias("text"))
    instances = p.select(F.expr("concat('i', p_partkey)").alias("path"), F.expr("concat('p', p_partkey)").alias("module"))
    return v.placed_style(style_observations(texts), instances).select("kind", "scope_path", "name", "line")
