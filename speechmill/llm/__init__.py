"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Each module has QUERIES, name -> callable(spark, sf_dir), and ORACLE, name -> DuckDB SQL.
"""
