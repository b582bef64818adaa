"""Catalog data on Spark: functions"""
