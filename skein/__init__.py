"""skein: archive analytics on Spark (index, list, resolve and read tar/gzip archives as DataFrames)."""
