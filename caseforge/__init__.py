"""caseforge: predictive analytics on case-by-feature tables, expressed as Spark plans."""
