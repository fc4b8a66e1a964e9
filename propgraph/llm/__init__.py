"""Training-data operators: tokenising, sharding, mixing, filtering and near-duplicate search.

Nothing outside this package imports it; ``queries`` registers its queries and SQL.
"""
