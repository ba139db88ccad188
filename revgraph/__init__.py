"""revgraph: a PySpark-native engine for revision-versioned data-lineage graphs."""
