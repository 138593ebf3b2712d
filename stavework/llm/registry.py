"""The queries of this subpackage and the DuckDB equivalents of those that SQL can express."""

from . import byte_bpe, chat, decontaminate, lm, phrases, quality, secrets, simhash, suffixes, token_files, toxicity, urls, whitening

MODULES = (decontaminate, urls, lm, byte_bpe, chat, toxicity, simhash, token_files, quality, secrets, phrases, suffixes, whitening)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in MODULES for k, f in m.ORACLES.items()}
