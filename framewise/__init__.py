"""Spark operators for exploring, cleaning, modelling and monitoring tabular data."""

__version__ = "0.1.0"
