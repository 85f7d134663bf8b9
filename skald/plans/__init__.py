"""Query languages and the registered queries with their SQL."""
