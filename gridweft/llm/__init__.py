"""Training-data operators: mixing, token output, deduplication, search, scoring, segmentation.

Nothing else in the package imports this subpackage, and it imports nothing from the rest.
"""
