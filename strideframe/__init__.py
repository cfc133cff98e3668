"""strideframe: ordered event streams with attached point snapshots, on Spark."""
