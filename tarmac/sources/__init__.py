"""Sources and sinks: given tables, raw sales files, star schema, writers."""

from tarmac.sources.tables import read_table, sales_view  # noqa: F401
