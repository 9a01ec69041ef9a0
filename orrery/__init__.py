"""Orrery: relational, graph and geometric analytics over moving objects, on PySpark."""
