"""lodestrand: batch-first retrieval and document analytics on PySpark."""
