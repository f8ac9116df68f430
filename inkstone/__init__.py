"""A Spark engine for CJK document processing."""
