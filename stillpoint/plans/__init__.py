"""Plans: registered queries with their SQL twins, and the extraction pipeline."""
