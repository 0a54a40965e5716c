"""DataFrame-to-DataFrame operators: filters, linkage, ranking, upkeep, reports."""
