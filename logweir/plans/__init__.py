"""Query plans: what a text query asks for, and its DataFrame."""
