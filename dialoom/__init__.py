"""dialoom: a PySpark-native engine for multi-turn question-answering corpora."""

__version__ = "0.1.0"
