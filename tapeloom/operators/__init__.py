"""DataFrame-to-DataFrame operators: joins, rollups, dedup, quality gates, publishing."""
