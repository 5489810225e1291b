"""Training-data operators: scoring, fingerprints, de-duplication, packing.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
