"""Reports that combine operators."""
