"""Query plans over the driver tables: fixtures that shape the tables into
the engine's canonical inputs, and the registry of checked queries."""
