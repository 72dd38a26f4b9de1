"""Readers of tables and of workflow documents."""
