"""Training-data operators: extraction, near duplicates, token output,
decontamination, counts, mixing, quality and license scans.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
