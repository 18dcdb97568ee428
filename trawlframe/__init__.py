"""Spark DataFrame operators for stratified spatial survey data."""
