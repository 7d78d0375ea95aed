"""Training-data pipeline operators: scans, filters, deduplication, tokenisation and web archives."""
