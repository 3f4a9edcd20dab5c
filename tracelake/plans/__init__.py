"""Event logs out of tables, and the queries over them."""
