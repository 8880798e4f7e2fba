"""Sources: tables, recorded event streams and sealed shard tables."""
