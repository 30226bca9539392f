"""Rating derivations, the registered queries and their SQL counterparts."""
