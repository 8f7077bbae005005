"""Tables and reference models."""
