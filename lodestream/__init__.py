"""lodestream: a PySpark-native analytics engine for instruments, documents and news."""
