"""Plan-versus-record reconciliation, and keyed site queries, as Spark jobs."""
