"""Training-data pipeline operators: decontamination, deduplication, PII,
packing, WARC, chat, quality, URL rules. Nothing else in the library imports
this subpackage; its queries live in ``rankfold.llm.queries``."""
