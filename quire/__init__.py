"""quire: document analytics as declarative Spark plans."""
