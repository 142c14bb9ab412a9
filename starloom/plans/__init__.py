"""The link model, filter states and query plans."""
