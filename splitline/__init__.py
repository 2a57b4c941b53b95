"""splitline: competitive-results analytics expressed as PySpark DataFrame transforms."""
