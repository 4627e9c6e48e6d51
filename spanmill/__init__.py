"""spanmill: masks as run-length spans, and the tables around them, on PySpark."""
