"""Operators over DataFrames: inventories, packing, distribution, cost, trends, routing, content."""
