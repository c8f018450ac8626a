"""strataq: a Spark-first engine for text-corpus and vector-retrieval analytics."""
