"""DataFrame operators: retrieval, filters, joins, maintenance, control plane."""
