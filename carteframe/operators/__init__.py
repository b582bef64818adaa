"""Catalog data on Spark: operators"""
