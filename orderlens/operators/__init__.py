"""Named queries and the enriched-table build."""
