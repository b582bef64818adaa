"""Catalog data on Spark: sources"""
