"""An analytics engine on PySpark for a SQLite-flavoured SQL dialect."""
