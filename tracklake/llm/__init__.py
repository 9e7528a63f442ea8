"""Operators for preparing training corpora: one module per operator, each a Spark job."""
