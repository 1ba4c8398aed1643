"""Spark operators that turn conversations, notes, source files and diffs into knowledge tables and answer retrieval queries over them."""
