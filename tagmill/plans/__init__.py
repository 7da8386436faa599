"""Registered queries: operators bound to the benchmark tables, with the SQL that checks them."""
