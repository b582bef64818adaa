"""Catalog data (menus, items, prices) as DataFrame programs."""
