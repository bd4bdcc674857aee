"""Jobs that chain the operators, and the registry of driver queries."""
