"""Filters, rules, paging, statistics, detail and export over the log tables."""
