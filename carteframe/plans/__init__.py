"""Catalog data on Spark: plans"""
