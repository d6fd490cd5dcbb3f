"""Spreadsheet-style analytics on PySpark."""
