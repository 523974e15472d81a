"""The queries of the operators here, and their SQL."""

from lens.llm import chat, decontaminate, edits, ngram_join, packing, pii, quality, secrets, substrings, warc

MODULES = (pii, secrets, decontaminate, packing, warc, substrings, edits, quality, ngram_join, chat)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
