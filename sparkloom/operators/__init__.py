"""Relational operators: temporal facts, aggregates, diffs, graphs, rules, search and work queues."""
