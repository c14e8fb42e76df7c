"""Gleaner: DataFrame operators that judge harvested web data on Spark."""
