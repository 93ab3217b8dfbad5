"""Training-data operators: quality, duplicates, leaks, language-model scores, URLs, HTML, packing, fingerprints."""
