"""Readers and writers: compressed pprof blobs and the Parquet profile store."""
