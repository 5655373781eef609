"""Readers, writers and the binding of tables to roles."""

from quillon.sources.files import detect_encoding, latest_parquet, peek_columns, read_text_table, sniff_separator
from quillon.sources.roles import ROLES, bind_roles, capabilities, facts, table
from quillon.sources.sinks import data_dictionary, render_layout, write_csv, write_delivery

__all__ = [
    "ROLES", "bind_roles", "capabilities", "data_dictionary", "detect_encoding", "facts", "latest_parquet", "peek_columns", "read_text_table", "render_layout",
    "sniff_separator", "table", "write_csv", "write_delivery",
]
