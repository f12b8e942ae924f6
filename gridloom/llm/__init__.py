"""Training-data pipeline operators (corpus cleaning, mixing, encoding, scoring).

Self-contained: nothing outside this subpackage imports it.
"""
