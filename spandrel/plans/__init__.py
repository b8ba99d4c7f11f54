"""Query plans composed from the operators, with their SQL twins."""
