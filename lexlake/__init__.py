"""lexlake: a vocabulary-enrichment lake written as PySpark DataFrame transforms."""
