"""kistwerk: a PySpark-native analytics engine for corpora of compound documents.

The optional subpackage ``kistwerk.llm`` is never imported from here.
"""

__version__ = "0.1.0"
