"""Readers of constraints, rules, file lists, baselines and fact tables."""
