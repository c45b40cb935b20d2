"""kgraph: a PySpark-native engine for knowledge-dependency graphs."""

__version__ = "0.1.0"
