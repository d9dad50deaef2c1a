"""Sources of the displacement engine."""
