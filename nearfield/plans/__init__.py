"""Filter language and query plans."""
