"""Training-data operators: sharding, decontamination, URL filters, toxicity,
SentencePiece, nearest neighbours, near-duplicates, licences, languages and
language-model scores. Nothing outside this subpackage imports it (but for the
guarded registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``).
"""
