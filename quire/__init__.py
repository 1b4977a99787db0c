"""Page-level document analytics and retrieval as composable PySpark DataFrame operators."""
