"""Clock-domain crossings: clocks and their relations, detection, and the verification phases.

Registers (ffs) are hier_path, source_id, edge, width, fanin ARRAY, reset_path, reset_async, seq;
their domain is (source_id, edge); the cell or module that holds one is its primitive, where that is known. Edges (ff_edges) are src_path, dst_path, has_comb, seq. Sources
are source_id, name, origin_signal, master_id, period_ns. Relations are a_id, b_id, relationship,
sdc_declared, seq. A crossing has the columns of ``CROSSING``; ``cid`` numbers its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators.connect import small
from gridweft.operators.graph import Found, cut, follow, ranked, reach

CROSSING = ["cid", "source_signal", "dest_signal", "source_domain", "dest_domain", "relationship", "category", "severity", "sync_type", "rule", "subrule", "waive_reason", "recommendation", "timing_basis_ns"]
MAX_PULSE_HOPS = 6


def domain_name(source: Column, edge: Column) -> Column:
    return F.concat_ws(":", source, edge)


# --- clocks --------------------------------------------------------------------------------


def auto_clocks(ports: DataFrame, defined: DataFrame) -> DataFrame:
    """Inputs of top with a clock's and no reset's name that no constraint defines."""
    rows = ports.where(F.col("is_top") & (F.col("direction") == "In") & names.is_cdc_clock(F.col("port_name")) & ~names.is_cdc_reset(F.col("port_name")))
    rows = rows.join(defined.select(F.col("origin_signal").alias("port_name")), "port_name", "left_anti")
    return rows.select(F.concat(F.lit("auto_"), F.col("port_name")).alias("source_id"), F.col("port_name").alias("name"), F.lit("AutoDetected").alias("type"), F.col("port_name").alias("origin_signal"), F.lit(None).cast("string").alias("master_id"), F.lit(None).cast("double").alias("period_ns"))


def constraint_sources(clocks: DataFrame, generated: DataFrame) -> DataFrame:
    """Clock sources of the tables of ``sources.sdc``: primary and generated ones, with their masters.

    clocks has name, period_ns, target; generated has name, source, target, divide_by, multiply_by,
    invert, in the file's order (column seq of both, if it matters). A generated clock's master is
    the first primary source, else the first generated one before it, that has its source as target
    or as name.
    """
    none = F.lit(None)
    at = lambda df: F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    first = clocks.select(F.concat(F.lit("sdc_"), "name").alias("source_id"), "name", F.lit("Primary").alias("type"), F.col("target").alias("origin_signal"), none.cast("string").alias("master_id"), "period_ns", F.lit(1).alias("divide_by"), F.lit(1).alias("multiply_by"), F.lit(False).alias("invert"), F.lit(0).alias("rank"), at(clocks).alias("seq"))
    rest = cut(generated.select(F.concat(F.lit("sdc_gen_"), "name").alias("source_id"), "name", F.lit("Generated").alias("type"), F.col("target").alias("origin_signal"), none.cast("double").alias("period_ns"), "divide_by", "multiply_by", "invert", F.lit(1).alias("rank"), at(generated).alias("seq"), "source"))
    first = cut(first)
    known = first.select("source_id", "name", "origin_signal", "rank", "seq").unionByName(rest.select("source_id", "name", "origin_signal", "rank", "seq"))
    keys = known.select(F.struct("rank", "seq", "source_id").alias("m"), F.explode(F.array_distinct(F.array("name", "origin_signal"))).alias("source"))
    wanted = rest.select("source_id", "source", F.struct("rank", "seq").alias("own")).join(keys, "source").where("m.rank < own.rank OR m.seq < own.seq")
    masters = wanted.groupBy("source_id").agg(F.min("m").alias("m")).select("source_id", F.col("m.source_id").alias("master_id"))
    both = first.unionByName(rest.join(masters, "source_id", "left").drop("source"))
    return both.drop("rank")


def master_roots(sources: DataFrame) -> DataFrame:
    """(source_id, root): the end of each chain of masters."""
    found = follow(sources.select(F.col("source_id").alias("node"), F.col("master_id").alias("next")))
    return found.select(F.col("node").alias("source_id"), "root")


def declared_relations(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs across the groups of each statement (stmt, kind, group_no, clock).

    A statement with one group sets its clocks against all other clocks.
    """
    ids = sources.select(F.col("name").alias("clock"), "source_id")
    rows = groups.join(ids, "clock")
    n = groups.groupBy("stmt").agg(F.max("group_no").alias("last"))
    rows = rows.join(n, "stmt")
    other = rows.select("stmt", F.col("group_no").alias("g2"), F.col("source_id").alias("b_id"))
    across = rows.join(other, "stmt").where("group_no < g2").select(F.col("source_id").alias("a_id"), "b_id", F.col("kind").alias("relationship"))
    alone = rows.where("last = 0")
    inside = alone.select("stmt", F.col("source_id").alias("b_id"))
    rest = alone.select("stmt", "kind", F.col("source_id").alias("a_id")).join(small(sources.select(F.col("source_id").alias("b_id")))).join(inside, ["stmt", "b_id"], "left_anti")
    both = across.unionByName(rest.select("a_id", "b_id", F.col("kind").alias("relationship")))
    return both.distinct().withColumn("sdc_declared", F.lit(True))


def inferred_relations(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Relations of pairs without one: Divided if they share a root, else Asynchronous.

    Pairs of a root come from a join on it; pairs of different roots are not listed, as an absent
    relation means Asynchronous.
    """
    roots = sources.join(master_roots(sources), "source_id").select("source_id", "root")
    pairs = roots.select(F.col("source_id").alias("a_id"), "root").join(roots.select(F.col("source_id").alias("b_id"), "root"), "root").where("a_id < b_id")
    either = known.select("a_id", "b_id").unionAll(known.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))
    return pairs.join(either, ["a_id", "b_id"], "left_anti").select("a_id", "b_id", F.lit("Divided").alias("relationship"), F.lit(False).alias("sdc_declared"))


def propagate_clocks(seeds: DataFrame, port_map: DataFrame) -> DataFrame:
    """(hier_path, source_id, depth): clock nets pushed down the port tree (parent_net, child_net), to its leaves."""
    edges = port_map.select(F.col("parent_net").alias("src"), F.col("child_net").alias("dst"))
    found = reach(edges, seeds.select("source_id", F.col("hier_path").alias("node")), keys=["source_id"])
    return found.select(F.col("node").alias("hier_path"), "source_id", "depth")


def register_domains(ffs: DataFrame, sources: DataFrame, nets: DataFrame) -> DataFrame:
    """The source of each register's clock: by name, else by the nearest enclosing scope's net."""
    by_name = sources.groupBy(F.col("name").alias("clock")).agg(F.min_by("source_id", "seq").alias("by_name"))
    rows = ffs.join(by_name, "clock", "left")
    parts = F.split(names.parent_of(F.col("hier_path")), r"\.")
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.concat_ws(".", F.slice(parts, 1, i), F.array(F.col("clock"))).alias("net")))
    near = rows.where("by_name IS NULL").select("hier_path", F.explode(scopes).alias("s")).join(nets.select(F.col("hier_path").alias("net"), F.col("source_id").alias("net_source")), F.col("s.net") == F.col("net"))
    near = near.groupBy("hier_path").agg(F.max_by("net_source", "s.depth").alias("by_net"))
    return rows.join(near, "hier_path", "left").withColumn("source_id", F.coalesce("by_name", "by_net")).drop("by_name", "by_net")


def relation_lookup(relations: DataFrame) -> DataFrame:
    """(a_id, b_id) in both orders with the first declared, else the first relation."""
    both = relations.unionByName(relations.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), *[c for c in relations.columns if c not in ("a_id", "b_id")]))
    first = F.min_by(F.struct("relationship", "sdc_declared"), F.struct((~F.col("sdc_declared")).alias("later"), "seq"))
    return both.groupBy("a_id", "b_id").agg(first.alias("r")).select("a_id", "b_id", "r.relationship", "r.sdc_declared")


# --- detection -----------------------------------------------------------------------------


def detect_crossings(edges: DataFrame, ffs: DataFrame, sources: DataFrame, relations: DataFrame, false_paths: DataFrame, gated: DataFrame) -> DataFrame:
    """Edges between registers of different domains, classified by the first rule that fits.

    gated holds the source_ids of gated nets. Unknown relations count as asynchronous.
    """
    cell = F.lower("primitive") if "primitive" in ffs.columns else F.lit(None).cast("string")
    reg = lambda side: ffs.where("source_id IS NOT NULL").select(F.col("hier_path").alias(f"{side}_path"), F.col("source_id").alias(f"{side}_id"), F.col("edge").alias(f"{side}_edge"), cell.alias(f"{side}_cell"))
    origin = F.when(F.coalesce("origin_signal", F.lit("")) != "", F.col("origin_signal")).otherwise(F.col("name"))
    src = lambda side: sources.select(F.col("source_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), origin.alias(f"{side}_origin"), F.col("period_ns").alias(f"{side}_period"))
    rows = edges.join(reg("src"), "src_path").join(reg("dst"), "dst_path").where("src_id <> dst_id OR src_edge <> dst_edge")
    rows = rows.join(src("src"), "src_id", "left").join(src("dst"), "dst_id", "left")
    look = relation_lookup(relations).select(F.col("a_id").alias("src_id"), F.col("b_id").alias("dst_id"), "relationship", "sdc_declared")
    rows = rows.join(look, ["src_id", "dst_id"], "left")
    rows = rows.join(false_paths.select(F.col("from_clk").alias("src_name"), F.col("to_clk").alias("dst_name"), F.lit(True).alias("is_false")).distinct(), ["src_name", "dst_name"], "left")
    gate = lambda side: gated.select(F.col("source_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_gated")).distinct()
    rows = rows.join(gate("src"), "src_id", "left").join(gate("dst"), "dst_id", "left")
    same = F.col("src_id") == F.col("dst_id")
    relation = F.when(same, "SameSource").otherwise(F.col("relationship"))
    rows = rows.withColumn("rel", relation)
    exclusive = F.col("rel").isin("PhysicallyExclusive", "LogicallyExclusive")
    leaf = lambda side: names.short_name(F.col(f"{side}_path"))
    inside = names.parent_of(F.col("src_path")) == names.parent_of(F.col("dst_path"))
    pair = lambda a, b: (leaf("src") == a) & (leaf("dst") == b)
    known = lambda name: F.coalesce(inside & (F.col("src_cell") == name) & (F.col("dst_cell") == name), F.lit(False))
    handshake = known(names.HANDSHAKE_CELL) & (pair(*names.HANDSHAKE_PAIRS[0]) | pair(*names.HANDSHAKE_PAIRS[1]))
    syncreg = known(names.SYNCREG_CELL) & pair(*names.SYNCREG_PAIR)
    async_ = ~same & (F.col("rel").isNull() | (F.col("rel") == "Asynchronous"))
    result = lambda category, severity, sync, waive: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(sync).alias("sync_type"), F.lit(waive).cast("string").alias("waive_reason"))
    ladder = (
        F.when(F.col("is_false"), result("INFO", "info", "none", "sdc_false_path"))
        .when(F.coalesce("sdc_declared", F.lit(False)) & exclusive & ~same, result("INFO", "info", "none", "sdc_clock_groups"))
        .when(handshake, result("INFO", "info", "handshake", None))
        .when(syncreg, result("INFO", "info", "two_ff", None))
        .when(async_, result("VIOLATION", "high", "none", None))
        .when(exclusive, result("INFO", "info", "none", None))
        .when(F.coalesce("src_gated", "dst_gated", F.lit(False)), result("INFO", "low", "none", None))
        .otherwise(result("CAUTION", "medium", "none", None))
    )
    text = (
        F.when(F.col("c.waive_reason").isNotNull(), F.concat(F.lit("waived by "), F.col("c.waive_reason")))
        .when(F.col("c.category") == "VIOLATION", F.concat(F.lit("insert a two-register synchronizer at "), F.col("dst_path")))
        .otherwise("review the timing assumptions of this crossing")
    )
    odd = F.filter(F.array("src_origin", "dst_origin"), lambda x: x.isNotNull() & ~names.is_cdc_clock(x))
    text = F.concat(text, F.when(F.size(odd) > 0, F.concat(F.lit(f"; clock names without any of {', '.join(names.CDC_CLOCKS)}: "), F.array_join(odd, ", "))).otherwise(""))
    out = rows.withColumn("c", ladder).select(
        F.concat_ws("#", "src_path", "dst_path", "seq").alias("cid"), F.col("src_path").alias("source_signal"), F.col("dst_path").alias("dest_signal"),
        domain_name(F.col("src_id"), F.col("src_edge")).alias("source_domain"), domain_name(F.col("dst_id"), F.col("dst_edge")).alias("dest_domain"),
        F.coalesce("rel", F.lit("inferred_asynchronous")).alias("relationship"), "c.category", "c.severity", "c.sync_type", F.lit("Ac_cdc01").alias("rule"),
        F.lit("").alias("subrule"), "c.waive_reason", text.alias("recommendation"), F.coalesce("dst_period", "src_period").alias("timing_basis_ns"),
    )
    return out


def unsafe_clock_rows(ffs: DataFrame, unsafe_sources: DataFrame) -> DataFrame:
    """A violation for each register on a clock that unsafe logic drives (Ac_cdc05)."""
    rows = ffs.join(unsafe_sources.select("source_id"), "source_id", "left_semi")
    domain, none = domain_name(F.col("source_id"), F.col("edge")), F.lit(None).cast("string")
    return rows.select(F.concat(F.lit("unsafe#"), F.col("hier_path")).alias("cid"), F.col("source_id").alias("source_signal"), F.col("hier_path").alias("dest_signal"), none.alias("source_domain"), domain.alias("dest_domain"), none.alias("relationship"), F.lit("VIOLATION").alias("category"), F.lit("high").alias("severity"), F.lit("none").alias("sync_type"), F.lit("Ac_cdc05").alias("rule"), F.lit("unsafe_clock").alias("subrule"), none.alias("waive_reason"), F.lit("clock comes from unsafe combinational logic").alias("recommendation"), F.lit(None).cast("double").alias("timing_basis_ns"))


# --- verification --------------------------------------------------------------------------


def _set(rows: DataFrame, when: Column, **values: Column | str) -> DataFrame:
    return rows.withColumns({k: F.when(when, F.lit(v) if isinstance(v, str) else v).otherwise(F.col(k)) for k, v in values.items()})



def synced() -> Column:
    return F.col("sync_type").isin("two_ff", "three_ff")



def next_register(ffs: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, next): of each register the first that it feeds alone, in its domain, without logic between."""
    domain = lambda p: ffs.select(F.col("hier_path").alias(f"{p}_path"), domain_name(F.col("source_id"), F.col("edge")).alias(f"{p}_dom"), (F.size("fanin") <= 1).alias(f"{p}_one"))
    rows = edges.where("NOT has_comb").join(domain("src"), "src_path").join(domain("dst"), "dst_path").where("src_dom = dst_dom AND dst_one")
    return rows.groupBy(F.col("src_path").alias("path")).agg(F.min_by("dst_path", F.struct("seq", "dst_path")).alias("next"))


def verify_chain(rows: DataFrame, ffs: DataFrame, edges: DataFrame, stages: int = 2) -> DataFrame:
    """Phase 1: chains of two or three registers, or a register that shifts itself; overwrites sync_type."""
    nxt = cut(next_register(ffs, edges))
    two = nxt.join(nxt.select(F.col("path").alias("next"), F.col("next").alias("third")), "next", "left").select(F.col("path").alias("dest_signal"), F.when(F.col("third").isNotNull(), "three_ff").otherwise("two_ff").alias("chain"))
    shift = ffs.where((F.col("width") >= 2) & (F.size("fanin") == 2) & F.array_contains("fanin", names.short_name(F.col("hier_path")))).select(F.col("hier_path").alias("dest_signal"), F.lit(True).alias("shifts"))
    out = rows.join(two, "dest_signal", "left").join(shift, "dest_signal", "left")
    out = out.withColumn("sync_type", F.coalesce("chain", F.when(F.col("shifts"), F.lit("two_ff")), F.lit("none")))
    length = F.when(F.col("sync_type") == "three_ff", 3).when(F.col("sync_type") == "two_ff", 2).otherwise(0)
    found = F.col("sync_type") != "none"
    out = _set(out, found & (length >= stages), category="INFO", severity="info", recommendation="")
    out = _set(out, found & (length < stages), category="CAUTION", severity="medium", recommendation=F.concat(F.lit("synchronizer has "), length.cast("string"), F.lit(f" stages but {stages} are required")))
    return out.select(*CROSSING)


def verify_comb(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Phase 2, Ac_cdc02: logic before the synchronizer, of any crossing."""
    first = edges.groupBy(F.col("src_path").alias("source_signal"), F.col("dst_path").alias("dest_signal")).agg(F.min_by("has_comb", "seq").alias("comb"))
    out = rows.join(first, ["source_signal", "dest_signal"], "left").withColumn("comb", F.coalesce("comb", F.lit(False)))
    return _set(out, F.col("comb"), category="CAUTION", severity="medium", rule="Ac_cdc02", subrule="", recommendation="combinational logic before the synchronizer").select(*CROSSING)


def with_count(rows: DataFrame, keys: list[str], name: str, where: Column | None = None) -> DataFrame:
    """Rows with the number of rows of their keys: partial counts, then a join that can be split."""
    counted = (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counted, keys, "left")


def verify_reconvergence(rows: DataFrame) -> DataFrame:
    """Phase 3, Ac_cdc03: synced crossings of a domain pair with two or more, unless a rule is more specific."""
    out = with_count(rows, ["source_domain", "dest_domain"], "n", F.col("source_domain").isNotNull())
    hit = (F.col("n") >= 2) & (F.col("sync_type") != "none") & F.col("rule").isin("", "Ac_cdc01", "Ac_cdc03")
    return _set(out, F.coalesce(hit, F.lit(False)), category="CAUTION", severity="medium", rule="Ac_cdc03", recommendation="signals of one domain cross independently and meet again").select(*CROSSING)


def _source_register(rows: DataFrame, ffs: DataFrame, *columns: str) -> DataFrame:
    return rows.join(ffs.select(F.col("hier_path").alias("source_signal"), *columns), "source_signal", "left")


def verify_bus(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 3b, Ac_cdc04: a register of several bits behind a plain chain, not named like gray code or a handshake."""
    leaf = F.lower(names.short_name(F.col("source_signal")))
    hit = synced() & F.col("rule").isin("", "Ac_cdc01", "Ac_cdc03") & (F.col("width") >= 2) & ~leaf.rlike(names.any_of(names.HANDSHAKE_OR_GRAY))
    out = _source_register(rows, ffs, "width")
    return _set(out, F.coalesce(hit, F.lit(False)), category="CAUTION", severity="medium", rule="Ac_cdc04", recommendation="wide bus crosses without gray code or handshake").select(*CROSSING)


def verify_resets(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 4, Ac_cdc06: an asynchronous reset from a register of another domain, not synchronized there.

    The register is found by the reset's path, else by its leaf name (the first by seq). A crossing
    of the pair is rewritten (the last of several); a missing one is added.
    """
    dom = domain_name(F.col("source_id"), F.col("edge"))
    users = ffs.where("reset_async AND reset_path IS NOT NULL AND source_id IS NOT NULL").select(F.col("hier_path").alias("user"), dom.alias("user_domain"), "reset_path")
    regs = ffs.where("source_id IS NOT NULL").select(F.col("hier_path").alias("cand"), dom.alias("cand_domain"), "seq")
    exact = users.join(regs, F.col("reset_path") == F.col("cand")).where("cand_domain <> user_domain").select("user", F.struct(F.lit(0).alias("rank"), "seq", "cand", "cand_domain").alias("c"))
    by_leaf = users.withColumn("leaf", names.short_name(F.col("reset_path"))).join(regs.withColumn("leaf", names.short_name(F.col("cand"))), "leaf").where("cand_domain <> user_domain").select("user", F.struct(F.lit(1).alias("rank"), "seq", "cand", "cand_domain").alias("c"))
    pick = exact.unionAll(by_leaf).groupBy("user").agg(F.min("c").alias("c")).join(users, "user")
    safe = rows.where("sync_type <> 'none'").select(F.col("source_signal").alias("cand"), F.col("dest_domain").alias("user_domain")).distinct()
    bad = cut(pick.select("user", "user_domain", "c.cand", "c.cand_domain").join(safe, ["cand", "user_domain"], "left_anti"))
    text = "asynchronous reset from another domain without a reset synchronizer"
    last = rows.groupBy("source_signal", "dest_signal").agg(F.max("cid").alias("last"))
    mark = bad.select(F.col("cand").alias("source_signal"), F.col("user").alias("dest_signal"), F.lit(True).alias("bad")).distinct()
    out = rows.join(last, ["source_signal", "dest_signal"]).join(mark, ["source_signal", "dest_signal"], "left")
    out = _set(out, F.coalesce(F.col("bad") & (F.col("cid") == F.col("last")), F.lit(False)), category="CAUTION", severity="high", rule="Ac_cdc06", recommendation=text).select(*CROSSING)
    new = bad.join(rows.select(F.col("source_signal").alias("cand"), F.col("dest_signal").alias("user")).distinct(), ["cand", "user"], "left_anti")
    none = F.lit(None).cast("string")
    add = new.select(F.concat_ws("#", F.lit("reset"), "cand", "user").alias("cid"), F.col("cand").alias("source_signal"), F.col("user").alias("dest_signal"), F.col("cand_domain").alias("source_domain"), F.col("user_domain").alias("dest_domain"), none.alias("relationship"), F.lit("CAUTION").alias("category"), F.lit("high").alias("severity"), F.lit("none").alias("sync_type"), F.lit("Ac_cdc06").alias("rule"), F.lit("").alias("subrule"), none.alias("waive_reason"), F.lit(text).alias("recommendation"), F.lit(None).cast("double").alias("timing_basis_ns"))
    return out.unionByName(add)


def verify_gray(rows: DataFrame) -> DataFrame:
    """Phase 5: three or more synced crossings of a domain pair whose sources share a name up to an index."""
    out = rows.withColumn("prefix", names.strip_index(F.col("source_signal")))
    keys = ["source_domain", "dest_domain", "prefix"]
    out = with_count(out, keys, "n", synced() & F.col("source_domain").isNotNull() & F.col("dest_domain").isNotNull())
    fifo = F.lower(names.short_name(F.col("prefix"))).rlike(names.any_of(names.FIFO_POINTERS))
    hit = F.coalesce(synced() & (F.col("n") >= 3), F.lit(False))
    kind = F.when(fifo, "async_fifo").otherwise("gray_code")
    return _set(out, hit, recommendation=F.concat(kind, F.lit(" synchronizer")), sync_type=kind).select(*CROSSING)


def verify_handshake(rows: DataFrame) -> DataFrame:
    """Phase 5: synced crossings both ways between two domains, a req one way and an ack back."""
    pairs = rows.where(synced()).where("source_domain <> dest_domain").groupBy("source_domain", "dest_domain").agg(F.bool_or(F.col("source_signal").contains("req")).alias("req"), F.bool_or(F.col("source_signal").contains("ack")).alias("ack"))
    back = pairs.select(F.col("source_domain").alias("dest_domain"), F.col("dest_domain").alias("source_domain"), F.col("req").alias("req_back"), F.col("ack").alias("ack_back"))
    good = pairs.join(back, ["source_domain", "dest_domain"]).where("(req AND ack_back) OR (ack AND req_back)").select("source_domain", "dest_domain", F.lit(True).alias("shakes"))
    out = rows.join(good, ["source_domain", "dest_domain"], "left")
    return _set(out, F.coalesce(F.col("shakes") & synced(), F.lit(False)), recommendation="handshake synchronizer", sync_type="handshake").select(*CROSSING)


def verify_pulse(rows: DataFrame, ffs: DataFrame, edges: DataFrame) -> DataFrame:
    """Phase 5: a register of the domain that takes two or more of the chain behind the crossing."""
    dom = ffs.select(F.col("hier_path").alias("p"), domain_name(F.col("source_id"), F.col("edge")).alias("d"), F.size("fanin").alias("n_in"))
    full = edges.join(dom.select(F.col("p").alias("src_path"), F.col("d").alias("src_dom")), "src_path").join(dom.select(F.col("p").alias("dst_path"), F.col("d").alias("dst_dom"), "n_in"), "dst_path").where("src_dom = dst_dom")
    full = cut(full.select("src_path", "dst_path", "has_comb", "n_in").distinct())
    steps = full.where("NOT has_comb AND n_in <= 1").select("src_path", "dst_path")
    heads = rows.where(synced()).select(F.col("dest_signal").alias("head")).distinct()
    # a chain has a second register; what follows is bounded by MAX_PULSE_HOPS beyond the third
    frontier = cut(heads.select("head", F.col("head").alias("node")))
    seen = Found(frontier)
    for _ in range(MAX_PULSE_HOPS + 2):
        frontier = cut(frontier.join(steps, F.col("node") == F.col("src_path")).select("head", F.col("dst_path").alias("node")).distinct().join(seen.all(), ["head", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    taken = seen.all().join(full.where("n_in >= 2"), F.col("node") == F.col("src_path")).groupBy("head", "dst_path").agg(F.countDistinct("node").alias("inputs")).where("inputs >= 2")
    good = taken.select(F.col("head").alias("dest_signal"), F.lit(True).alias("pulses")).distinct()
    out = rows.join(good, "dest_signal", "left")
    return _set(out, F.coalesce(F.col("pulses") & synced(), F.lit(False)), recommendation="pulse synchronizer", sync_type="pulse").select(*CROSSING)


def verify_mux(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 5: the first register has two or more inputs, one of them synced into its domain elsewhere."""
    known = rows.where(synced()).select(names.short_name(F.col("source_signal")).alias("input"), "dest_domain").distinct()
    inputs = ffs.where(F.size("fanin") >= 2).select(F.col("hier_path").alias("dest_signal"), F.explode("fanin").alias("input"))
    hit = rows.where(synced()).select("cid", "dest_signal", "dest_domain").join(inputs, "dest_signal").join(known, ["input", "dest_domain"], "left_semi").select("cid").distinct().withColumn("muxed", F.lit(True))
    return _set(rows.join(hit, "cid", "left"), F.coalesce("muxed", F.lit(False)), recommendation="multiplexer synchronizer", sync_type="mux").select(*CROSSING)


def verify_fanout(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Phase 6, Ac_cdc05: the first register of a chain feeds more than one (edges, not registers, count)."""
    out_edges = edges.groupBy(F.col("src_path").alias("dest_signal")).agg(F.count(F.lit(1)).alias("n_out"))
    out = rows.join(out_edges, "dest_signal", "left")
    return _set(out, F.coalesce(synced() & (F.col("n_out") > 1), F.lit(False)), category="CAUTION", severity="medium", rule="Ac_cdc05", subrule="early_fanout", recommendation="data is used before the synchronizing chain ends").select(*CROSSING)


def _pointer_groups(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    out = rows.withColumn("prefix", names.strip_index(F.col("source_signal"))).withColumn("member", F.col("sync_type").isin(*kinds))
    return with_count(out, ["prefix"], "bits", F.col("member"))


def verify_johnson(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 7: an even number, four or more, of crossings of a prefix with a source that takes its own prefix."""
    out = _pointer_groups(rows, ("async_fifo", "gray_code", "two_ff", "three_ff"))
    bare = F.transform("fanin", lambda x: names.strip_index(names.short_name(x)))
    shifts = _source_register(out.where("member"), ffs, "fanin").where(F.array_contains(bare, names.short_name(F.col("prefix")))).select("prefix", F.lit(True).alias("shifts")).distinct()
    out = out.join(shifts, "prefix", "left")
    hit = F.coalesce(F.col("member") & F.col("shifts") & (F.col("bits") >= 4) & (F.col("bits") % 2 == 0), F.lit(False))
    return _set(out, hit, sync_type="johnson_counter", category="INFO", severity="info", recommendation=F.concat(F.lit("Johnson counter of "), F.col("bits").cast("string"), F.lit(" bits"))).select(*CROSSING)


def verify_fifo_depth(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 8, Ac_cdc07: pointers of which a source takes an input named like a depth."""
    out = _pointer_groups(rows, ("async_fifo", "gray_code"))
    wraps = _source_register(out.where("member"), ffs, "fanin").where(F.exists("fanin", lambda x: F.lower(x).rlike(names.any_of(names.FIFO_WRAP)))).select("prefix", F.lit(True).alias("wraps")).distinct()
    hit = F.coalesce(F.col("member") & F.col("wraps"), F.lit(False))
    return _set(out.join(wraps, "prefix", "left"), hit, category="CAUTION", severity="medium", rule="Ac_cdc07", recommendation="depth may not be a power of two").select(*CROSSING)


def verify_clock_as_data(rows: DataFrame, ffs: DataFrame, sources: DataFrame) -> DataFrame:
    """Phase 9, Ac_cdc09: a row for each register whose first such input is another clock's name."""
    clocks = sources.select(F.explode(F.array("name", "origin_signal")).alias("input")).where("input <> ''").distinct()
    own = sources.select("source_id", F.when(F.coalesce("origin_signal", F.lit("")) != "", F.col("origin_signal")).otherwise(F.col("name")).alias("own"))
    taken = ffs.join(own, "source_id", "left").select("hier_path", domain_name(F.col("source_id"), F.col("edge")).alias("domain"), "own", F.posexplode("fanin").alias("pos", "input")).where("own IS NULL OR input <> own").join(clocks, "input", "left_semi")
    first = taken.groupBy("hier_path", "domain").agg(F.min_by("input", "pos").alias("input"))
    none = F.lit(None).cast("string")
    add = first.select(F.concat_ws("#", F.lit("clock"), "input", "hier_path").alias("cid"), F.col("input").alias("source_signal"), F.col("hier_path").alias("dest_signal"), none.alias("source_domain"), F.col("domain").alias("dest_domain"), none.alias("relationship"), F.lit("CAUTION").alias("category"), F.lit("medium").alias("severity"), F.lit("none").alias("sync_type"), F.lit("Ac_cdc09").alias("rule"), F.lit("").alias("subrule"), none.alias("waive_reason"), F.lit("clock is used as data").alias("recommendation"), F.lit(None).cast("double").alias("timing_basis_ns"))
    return rows.unionByName(add)


def verify_many_domains(rows: DataFrame) -> DataFrame:
    """Phase 10, Ac_cdc11: a source that crosses into two or more domains; INFO becomes CAUTION."""
    many = rows.where("source_domain IS NOT NULL AND dest_domain IS NOT NULL").groupBy("source_signal").agg(F.countDistinct("dest_domain").alias("n_dest")).where("n_dest >= 2")
    out = rows.join(many, "source_signal", "left")
    hit = F.coalesce(F.col("n_dest").isNotNull() & F.col("source_domain").isNotNull() & (F.col("category") != "WAIVED"), F.lit(False))
    note = F.lit("signal crosses into several domains independently")
    out = _set(out, hit, recommendation=F.when(F.col("recommendation") == "", note).otherwise(F.concat_ws(". ", "recommendation", note)), rule=F.when(F.col("rule") == "", F.lit("Ac_cdc11")).otherwise(F.col("rule")), subrule="many_domains")
    return _set(out, hit & (F.col("category") == "INFO"), severity="medium", category="CAUTION").select(*CROSSING)


def verify_quasi_static(rows: DataFrame, ffs: DataFrame) -> DataFrame:
    """Phase 11, Ac_cdc12: a second, informational row for sources named like settings or without inputs."""
    named = F.lower(names.short_name(F.col("source_signal"))).rlike(names.any_of(names.QUASI_STATIC))
    still = _source_register(rows, ffs, "fanin").where(named | (F.size("fanin") == 0))
    add = still.withColumns({"cid": F.concat(F.lit("static#"), F.col("cid")), "category": F.lit("INFO"), "severity": F.lit("info"), "rule": F.lit("Ac_cdc12"), "subrule": F.lit(""), "recommendation": F.lit("the signal may be quasi-static"), "waive_reason": F.lit(None).cast("string")})
    return rows.unionByName(add.select(*CROSSING))


def verify(rows: DataFrame, ffs: DataFrame, edges: DataFrame, sources: DataFrame, stages: int = 2) -> DataFrame:
    """All phases in their order; each rewrites what earlier ones found."""
    ffs, edges = cut(ffs), cut(edges)
    rows = cut(verify_bus(verify_reconvergence(verify_comb(verify_chain(rows, ffs, edges, stages), edges)), ffs))
    rows = cut(verify_handshake(verify_gray(verify_resets(rows, ffs))))
    rows = cut(verify_fanout(verify_mux(verify_pulse(rows, ffs, edges), ffs), edges))
    rows = cut(verify_fifo_depth(verify_johnson(rows, ffs), ffs))
    return verify_quasi_static(verify_many_domains(verify_clock_as_data(rows, ffs, sources)), ffs)


def apply_cdc_waivers(rows: DataFrame, waivers: DataFrame) -> DataFrame:
    """Waived crossings: an exact pair 'source -> dest', or a pattern that fits either end; the first rule counts."""
    pair = F.concat_ws(" -> ", "source_signal", "dest_signal")
    either = names.trailing_star_match(F.col("source_signal"), F.col("w.pattern")) | names.trailing_star_match(F.col("dest_signal"), F.col("w.pattern"))
    hit = (pair == F.col("w.crossing")) | F.when(F.col("w.pattern") != "", either).otherwise(F.lit(False))
    rules = small(waivers.select(F.struct("seq", "id", F.coalesce("crossing", F.lit("")).alias("crossing"), F.coalesce("pattern", F.lit("")).alias("pattern"), "reason").alias("w")))
    first = rows.select("cid", "source_signal", "dest_signal").join(rules, hit).groupBy("cid").agg(F.min_by("w.reason", "w.seq").alias("reason"), F.lit(True).alias("waived"))
    out = rows.join(first, "cid", "left")
    return _set(out, F.coalesce("waived", F.lit(False)), waive_reason=F.col("reason"), category="WAIVED").select(*CROSSING)


def ignore_gated(rows: DataFrame) -> DataFrame:
    return rows.where("severity <> 'low'")


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("category") == c).alias(c.lower()) for c in ("VIOLATION", "CAUTION", "INFO", "WAIVED", "CONVENTION")])


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with an id of their category and rank in it, such as CAUTION-2."""
    found = ranked(rows, ["source_signal", "dest_signal", "cid"], ["category"])
    return found.select(*rows.columns, F.concat_ws("-", "category", "rank").alias("id"))


def registers_per_domain(ffs: DataFrame) -> DataFrame:
    return ffs.groupBy(domain_name(F.col("source_id"), F.col("edge")).alias("domain")).agg(F.count(F.lit(1)).alias("n_ffs"))
