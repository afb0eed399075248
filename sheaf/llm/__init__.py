"""Training-data operators: filtering, deduplication, decontamination, packing, sharding and scoring.

Nothing outside this subpackage imports it.
"""
