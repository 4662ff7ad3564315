"""Document change-capture, query and corpus-preparation jobs on PySpark."""
