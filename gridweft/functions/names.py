"""Tests and rewrites of hierarchical names, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists (fixed values).
NO_CONNECT = ("nc", "unused", "unconn", "unconnected")
CDC_CLOCKS = ("clk", "clock", "ck")
CDC_RESETS = ("reset", "rstn", "rst_n", "rst")
CONN_CLOCKS = ("clk", "clock")
CONN_RESETS = ("rst", "reset")
PLL = ("PLL", "MMCM", "DCM", "CLKGEN")
CLOCK_GATES = ("icg", "clkgate", "clock_gate", "clk_gate", "cg")
REGISTER_CELLS = ("dff", "sdff", "dffr", "fdre", "fdce", "fdrse")
HANDSHAKE_OR_GRAY = ("gray", "gry", "req", "ack", "valid", "ready", "start", "done", "enq", "deq", "push", "pop")
FIFO_POINTERS = ("ptr", "addr", "wr_ptr", "rd_ptr", "wptr", "rptr", "fifo")
QUASI_STATIC = ("cfg_", "config_", "mode_", "static_")
FIFO_WRAP = ("depth", "size", "entries")
# Known synchronizer cells and their registers (fixed values).
HANDSHAKE_CELL, HANDSHAKE_PAIRS = "isochronous_4phase_handshake", (("src_req_q", "dst_req_q"), ("dst_ack_q", "src_ack_q"))
SYNCREG_CELL, SYNCREG_PAIR = "syncreg", ("regA", "regB")
# Names of a clock gate's outputs (fixed values).
GATE_OUTPUTS = ("q", "gclk", "clk_out", "eclk")


def word_pattern(words: tuple[str, ...], boundary: str) -> str:
    """Any of the words between boundaries, case-insensitive."""
    return f"(?i)(?:^|{boundary})(?:{'|'.join(map(re.escape, words))})(?:$|{boundary})"


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


def full_path(instance: Column, port: Column) -> Column:
    return F.concat_ws(".", instance, port)


def short_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def parent_of(path: Column) -> Column:
    """What stands before the last dot; empty without a dot."""
    return F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)


def strip_index(name: Column) -> Column:
    """x[3] and x3 become x; a bracket is stripped first, else digits at the end."""
    return F.when(name.contains("["), F.regexp_replace(name, r"\[[^\[]*$", "")).otherwise(F.regexp_replace(name, r"(?<=.)[0-9]+$", ""))


def port_range(name: Column, width: Column) -> Column:
    return F.when(width > 1, F.concat(name, F.lit("["), (width - 1).cast("string"), F.lit(":0]"))).otherwise(name)


def is_no_connect(port: Column) -> Column:
    return port.rlike(word_pattern(NO_CONNECT, "[^A-Za-z0-9]")) | (F.lower(port) == "no_connect")


def is_cdc_clock(name: Column) -> Column:
    return short_name(name).rlike(word_pattern(CDC_CLOCKS, "_"))


def is_cdc_reset(name: Column) -> Column:
    return F.lower(short_name(name)).rlike(any_of(CDC_RESETS))


def is_conn_clock(name: Column) -> Column:
    return F.lower(name).rlike(any_of(CONN_CLOCKS))


def is_conn_reset(name: Column) -> Column:
    return F.lower(name).rlike(any_of(CONN_RESETS))


def is_pll(module: Column) -> Column:
    return F.upper(module).rlike(any_of(PLL))


def is_clock_gate(module: Column) -> Column:
    return module.rlike(word_pattern(CLOCK_GATES, "[^A-Za-z0-9]"))


def is_register_cell(module: Column) -> Column:
    return module.rlike(word_pattern(REGISTER_CELLS, "[^A-Za-z]"))


def glob_to_like(pattern: Column) -> Column:
    """A glob with * and ? as a LIKE pattern; every other character stands for itself."""
    literal = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.translate(literal, "*?", "%_")


def glob_match(text: Column, pattern: Column) -> Column:
    return F.call_function("like", text, glob_to_like(pattern))


def trailing_star_match(text: Column, pattern: Column) -> Column:
    """Equality, or the prefix before a final star."""
    return F.when(pattern.endswith("*"), text.startswith(F.regexp_replace(pattern, r"\*$", ""))).otherwise(text == pattern)


MAX_PATTERN = 256


def safe_pattern(pattern: str) -> bool:
    """Whether a user's regular expression may run: short, valid and without nested quantifiers."""
    if len(pattern) > MAX_PATTERN or re.search(r"[+*}][^()|]*\)[+*{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
