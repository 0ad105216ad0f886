"""textquarry: corpus building, hybrid retrieval and corpus analytics as PySpark DataFrame operators."""
