"""Column functions: text, hashes, vectors, receipts, image features."""
