"""Declarative extraction of structured records from tables of web pages, on Spark."""
