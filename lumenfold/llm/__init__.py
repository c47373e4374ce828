"""Training-data operators: mixing, formatting, scoring, archives, sharding,
filtering, fingerprints, packing and near-duplicate removal.

Nothing outside this folder imports it.
"""
