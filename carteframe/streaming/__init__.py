"""Catalog data on Spark: streaming"""
