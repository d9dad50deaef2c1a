"""Functions of the displacement engine."""
