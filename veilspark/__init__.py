"""Anonymisation and privacy evaluation of tables, as Spark DataFrame jobs."""

from veilspark.spec import QI

__all__ = ["QI"]
