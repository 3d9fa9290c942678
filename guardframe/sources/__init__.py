"""Readers of tables and of policy configurations."""
