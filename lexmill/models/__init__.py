"""External-model steps behind a provider interface."""
