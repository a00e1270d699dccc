"""The corpus pipeline: quality filter, near-dedup, removal of repeated passages, packing. Its stages are in kistwerk.llm.pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the columns
of documents. A text that the third stage cuts keeps its doc_id; n_chars follows its new length.
"""

from kistwerk.llm.pipeline import ORACLE_SQL, STAGES, distinct_documents, good_documents, packed, run, unrepeated_documents

__all__ = ["ORACLE_SQL", "STAGES", "distinct_documents", "good_documents", "packed", "run", "unrepeated_documents"]
