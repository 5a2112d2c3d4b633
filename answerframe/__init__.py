"""Evaluation of list-valued question answering as Spark DataFrame operators."""

__version__ = "0.1.0"
