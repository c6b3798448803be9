"""ledgerloom: Spark-first operators for tables recovered from scanned documents."""
