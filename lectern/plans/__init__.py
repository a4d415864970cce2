"""Read tools composed of operators, and the registered queries."""
