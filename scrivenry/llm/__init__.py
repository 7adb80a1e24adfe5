"""Training-data operators: token files, counts, decontamination, near-dedup, packing, fingerprints,
language ID, secret scans, WARC and sharding.  Nothing else in the library imports this subpackage."""
