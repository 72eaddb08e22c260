"""Training-data operators: language id, token files, quality rules, secret
scans, toxicity, near-duplicate joins, BPE, substring dedup, embedding
near-dedup and sequence packing.  Nothing else in the library imports this
subpackage."""
