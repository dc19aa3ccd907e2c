"""lorekeep: a PySpark engine for encyclopedia-style document corpora."""
