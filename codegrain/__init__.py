"""Analytics over corpora of source code and text, written for PySpark."""
