"""Training-data operators: scans, filters, near duplicates, tokenisation and shard output."""
