"""corpusloom: a Spark-first engine for building, auditing and comparing text and code corpora."""

__version__ = "0.1.0"
