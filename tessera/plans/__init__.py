"""Query bindings of the operators to tables."""
